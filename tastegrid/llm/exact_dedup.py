"""Exact duplicates by a 128-bit content hash, with bytes compared inside groups."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .stages import staged
from .columns import ascii_lower


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep: str = "min",
                     digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: the group of equal texts it is in, and which row stays.

    Texts are equal when they are identical after lower-casing A-Z. Groups are found
    by the 128-bit ``digest`` of the text; grouping the texts themselves below their
    digest compares the bytes, and digests that stand for several texts are told
    apart by the texts. ``keep`` says whether the smallest or largest id stays.

    Columns: ``id_col``, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. Of repeated rows with the id that stays, one is
    kept. A row without id stays only where no row of its group has an id; keep_id is
    null then. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    # The first grouping combines copies before the shuffle, so a group of copies
    # that holds much of the table stays one row per task.
    shared = staged(
        rows.groupBy("digest", "body").agg(F.count("*").alias("n"))
        .groupBy("digest").agg(F.count("*").alias("texts"))
        .where("texts > 1").select("digest"),
        "shared-digests",
    )
    told_apart = shared.isEmpty()
    plain = rows if told_apart else rows.join(shared, "digest", "left_anti")
    groups = _grouped(plain.withColumn("key", F.col("digest")), keep)
    if not told_apart:
        mixed = rows.join(shared, "digest", "left_semi")
        groups = groups.union(_grouped(mixed.withColumn("key", F.col("body")), keep))
    return groups.withColumnRenamed("id", id_col)


def _grouped(rows: DataFrame, keep: str) -> DataFrame:
    """Rows with equal ``key`` are a group. Both sides of the join are files, so Spark
    knows their sizes and can split the rows of a hot key."""
    keyed = staged(
        rows.select(
            "id", "key", F.sha2("body", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-keys",
    )
    if keep == "min":
        best = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    elif keep == "max":
        best = F.max(F.struct(F.col("id").isNotNull(), "id", "row"))
    else:
        raise ValueError(f"keep must be min or max, not {keep!r}")
    groups = staged(
        keyed.groupBy("key").agg(best.alias("best"), F.count("*").alias("group_size"))
        .select("key", "group_size", F.col("best.id").alias("keep_id"),
                F.col("best.row").alias("keep_row")),
        "exact-groups",
    )
    return keyed.join(groups, "key").select(
        "id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The rows that go are the shorter list, so they are the side that is looked up.
    Where an id is repeated with one text, any one of its rows stays.
    """
    found = staged(exact_duplicates(docs, id_col, text_col, keep), "exact-found")
    other = ~F.col(id_col).eqNullSafe(F.col("keep_id"))
    gone = found.where(other).select(
        F.col(id_col).alias("gone_id"), F.col("text_sha256").alias("gone_sha")
    ).distinct()
    sha = F.sha2(ascii_lower(docs[text_col]), 256)
    left = docs.join(
        gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti"
    )
    if found.where(~other & ~F.col("kept")).isEmpty():
        return left
    name = "text_sha256_of_row"
    return (
        left.withColumn(name, F.sha2(ascii_lower(F.col(text_col)), 256))
        .dropDuplicates([id_col, name]).drop(name)
    )
