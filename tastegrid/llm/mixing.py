"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, shuffled, lie on a line of words, which is cut into blocks
of equal length. Slot i of the schedule maps the i-th golden-ratio point through the
cumulative targets to a source; the k-th slot of a source takes its k-th block. At any
place of the schedule each source has so far had its share, up to a few blocks.
"""

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .stages import staged
from .columns import SPACE, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
# Words of a block; slots and blocks are as many as the mix has words, by this.
BLOCK = 4096
# Documents that are ordered together, at most 16 times as many by the way they are cut.
BUCKET_ROWS = 256
# Slots whose ranks are counted together.
CHUNK = 1 << 16


def golden_point(slot: Column) -> Column:
    """The fractional part of ``slot`` times the golden ratio, to 2^-30 for any slot:
    upper and lower bits are multiplied on their own, so that no digit is lost."""
    getcontext().prec = 60
    ratio = (Decimal(5).sqrt() - 1) / 2
    upper = F.shiftright(slot, 20)
    lower = slot - F.shiftleft(upper, 20)
    point = upper * float(ratio * 2**20 % 1) + lower * float(ratio)
    return point - F.floor(point)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   passes: int = PASSES) -> DataFrame:
    """Targets of ``sizes (source, source_size)``, one row per source.

    Sources in order of their code points, null last, have the ``weights`` in turn and
    share ``share`` times all words; a target stops at ``passes`` times its source's
    size, and the excess goes to the others by weight until none is above.

    Adds number, target. The windows order the sources, not the documents.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    first = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")
    )
    # Going from the source that fills up first to the last: the level of words per
    # weight if the sources before stop at their limits. The largest is the true one.
    level = (
        (F.col("whole") - F.col("stopped")) / (F.col("all_weights") - F.col("stopped_weights"))
    )
    return (
        sizes.withColumn("number", F.row_number().over(in_order) - 1)
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * passes)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(every) * share)
        .withColumn("all_weights", F.sum("weight").over(every))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(first), F.lit(0)))
        .withColumn("stopped_weights", F.coalesce(F.sum("weight").over(first), F.lit(0.0)))
        .withColumn("level", F.max(level).over(every))
        .withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "number", "target")
    )


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(slot, key, block)``: which block of which source each slot takes.

    ``sources (key, number, words)``, with the words that the mix takes from each. A
    source has as many slots as it has blocks to give; what the points leave it short
    of comes after all others, and what they give beyond it is left out.
    """
    blocks = F.ceil(F.col("words") / block)
    every, before = Window.partitionBy(), Window.orderBy("number").rowsBetween(
        Window.unboundedPreceding, -1)
    shares = staged(
        sources.where("words > 0").withColumn("blocks", blocks)
        .withColumn("all_words", F.sum("words").over(every))
        .withColumn("slots", F.sum("blocks").over(every))
        .withColumn("sources", F.count("*").over(every))
        .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("lo", F.col("start") / F.col("all_words"))
        .withColumn("hi", (F.col("start") + F.col("words")) / F.col("all_words")),
        "mix-shares",
    )
    size = shares.select("slots", "sources").first()
    if size is None:
        return spark.createDataFrame([], "slot long, key string, block long")
    # Cells of the unit interval make the search for a point's source an equi-join.
    cells = 4 * size["sources"]
    cell = F.least(F.floor(F.col("point") * cells), F.lit(cells - 1))
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    spans = shares.select(
        "key", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * cells), last)).alias("cell"),
    )
    points = staged(
        spark.range(size["slots"]).withColumnRenamed("id", "slot")
        .withColumn("point", golden_point(F.col("slot"))).withColumn("cell", cell)
        .join(spans, "cell").where("lo <= point and point < hi")
        .select("slot", "key", F.floor(F.col("slot") / CHUNK).alias("chunk")),
        "mix-points",
    )
    counts = points.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    in_chunk = Window.partitionBy("key", "chunk").orderBy("slot")
    ranked = (
        points.withColumn("place", F.row_number().over(in_chunk) - 1)
        .join(starts, ["key", "chunk"])
        .join(shares.select("key", "blocks"), "key")
        .withColumn("block", F.col("first") + F.col("place"))
        .where("block < blocks")
    )
    had = counts.groupBy("key").agg(F.sum("n").alias("had"))
    short = (
        shares.join(had, "key", "left")
        .withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
        .withColumn("block", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)))
        .withColumn("slot", F.col("slots") + F.col("number")
                    + (F.col("block") - F.col("had")) * F.col("sources"))
    )
    columns = ["slot", "key", F.col("block").cast("long").alias("block")]
    return ranked.select(*columns).union(short.select(*columns))


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          source_col: str = "source", row: Column | None = None, **options) -> DataFrame:
    """What the mix takes of each document, pass by pass and block by block.

    One row per row of ``docs`` and piece taken: row, doc_id, source, size,
    source_size, target, at (where the document lies on its source's line), pass,
    block, slot, taken. A document that isn't taken has one row with 0 taken. A source
    is gone through at most ``passes`` times, so no document is taken more often.

    A null text has no words; a null source is a source. A document's place on the
    line follows a hash of its id, and then its id, so reruns agree; repeated rows lie
    side by side.
    """
    block = options.pop("block", BLOCK)
    passes = options.get("passes", PASSES)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    rows = staged(
        docs.select(
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("place"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = staged(
        source_targets(sizes.drop("key"), passes=passes, **options).select(
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("key"),
            "number", "source_size", "target", F.round("target").cast("long").alias("words"),
        ),
        "mix-targets",
    )
    placed = _placed(rows, targets)
    # Where a document lies in each pass, as far as the source's target goes.
    turns = placed.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    ).withColumn("start", F.col("at") + F.col("pass") * F.col("source_size")).withColumn(
        "end", F.least(F.col("start") + F.col("size"), F.col("words"))
    )
    taken = turns.where("end > start").withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))),
    ).withColumn(
        "taken",
        F.least(F.col("end"), (F.col("block") + 1) * block)
        - F.greatest(F.col("start"), F.col("block") * block),
    )
    slots = schedule(docs.sparkSession, targets, block)
    fields = ["row", "doc_id", "source", "size", "source_size", "target", "at", "pass"]
    none = turns.where("pass = 0 and end <= start")
    empty = [F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("slot"),
             F.lit(0).cast("long").alias("taken")]
    return taken.join(slots, ["key", "block"]).select(*fields, "block", "slot", "taken").union(
        none.select(*fields, *empty)
    )


def _placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with their place on the line of their source, in two steps: by the
    first digits of the hash, and within rows that share them. No step holds a source."""
    digits, count = 0, rows.count()
    while count > BUCKET_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sums.select(
        "key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bucket_at")
    )
    within = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size", "row")
    running = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return staged(
        rows.withColumn("inside", running - F.col("size"))
        .join(starts, ["key", "bucket"]).withColumn("at", F.col("bucket_at") + F.col("inside"))
        .select("row", "doc_id", "source", "key", "size", "at")
        .join(targets.select("key", "source_size", "target", "words"), "key"),
        "mix-placed",
    )


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix
    takes of it, repeats counted), first_slot (of the schedule that takes of it, null
    without one). Columns are read as ``mixed`` says."""
    return (
        mixed(docs, **options)
        .groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot")).drop("row")
    )


def mix_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document appears once for
    each pass that takes it, and the last of its source may be cut after a word.

    The rows are in the order of the schedule, by ranges of it: a document comes with the
    first slot that takes of it, and those of one slot as they lie in its block. Whoever
    reads the files one after the other has had each source's share at any place, but for
    a few blocks.

    A column n_chars, where there is one, is that of the text as cut.
    """
    row = "row_of_mix"
    held = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    turns = (
        mixed(held, text_col=text_col, row=F.col(row), **options).where("taken > 0")
        .groupBy(F.col("row").alias(row), F.col("pass").alias("pass_of_mix"), F.col("size").alias("size_of_mix"))
        .agg(F.sum("taken").alias("taken_of_mix"), F.min("slot").alias("slot_of_mix"),
             F.first("at").alias("at_of_mix"))
    )
    words = F.expr(f"regexp_extract_all({text_col}, '[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*', 0)")
    cut = F.when(
        F.col("taken_of_mix") < F.col("size_of_mix"),
        F.array_join(F.slice(words, 1, F.col("taken_of_mix").cast("int")), ""),
    ).otherwise(F.col(text_col))
    out = held.join(turns, row).withColumn(text_col, cut)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length(text_col).cast(kind))
    order = ["slot_of_mix", "pass_of_mix", "at_of_mix", row]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
