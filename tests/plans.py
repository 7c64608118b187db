"""What a plan has read, after it has run."""


def leaves(plan):
    """The scans of an executed plan, those inside finished query stages included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from leaves(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from leaves(plan.plan())
    else:
        children = plan.children()
        if not children.size():
            yield plan
        for i in range(children.size()):
            yield from leaves(children.apply(i))


def files_read(df):
    """``df`` run to its end: its rows, and the files of each file scan, by their folder."""
    rows = df.collect()
    found = {}
    for leaf in leaves(df._jdf.queryExecution().executedPlan()):
        if leaf.getClass().getSimpleName().startswith("FileSourceScan"):
            place = leaf.relation().location().rootPaths().apply(0).toString()
            found[place] = leaf.metrics().apply("numFiles").value()
    return rows, found
