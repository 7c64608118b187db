"""Connected components by alternating stars: a few joins per round, all in Spark."""

from pyspark.sql import DataFrame, functions as F

from .stages import staged


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``edges (a, b)``: the smallest id reachable.

    Each round links the larger neighbours of every id to its smallest neighbour, and
    then the smaller ones; the number of edges never grows, and the rounds are about
    the logarithm of the longest path. What a round joins lies in files, so that Spark
    can split the edges of a hot id. Edges of an id to itself or to null are ignored;
    no edges give no rows.
    """
    edges = _settled(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ))
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = edges.union(edges.select("b", "a"))
        low = staged(both.groupBy("a").agg(F.min("b").alias("low")), "star-low")
        large = both.join(low, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("low", "a").alias("b")
        )
        low = staged(large.groupBy("a").agg(F.min("b").alias("low")), "star-low")
        small = large.join(low, "a").where("b <> low").select(
            F.col("b").alias("a"), F.col("low").alias("b")
        )
        edges = _settled(small.union(low))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _settled(edges: DataFrame) -> DataFrame:
    return staged(edges.distinct(), "star-edges")
