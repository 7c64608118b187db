"""Tables laid out by a key, and reads that skip what they don't ask for.

A laid-out table has one folder for each part of its key's hashes. The column of the
folders is named after the key and the number of parts, ``mid_in_64`` say, so that a table
tells how it lies. In a folder the rows are sorted by the key, and each file has a Bloom
filter on it. A lookup then reads the folders of the keys asked for, of these the row
groups whose range and filter admit a key, and nothing else.
"""

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import SMALL_ROWS, small_side
from ..session import staged

# Rows of one file of a part at most.
FILE_ROWS = 10_000_000


def part_column(key: str, parts: int) -> str:
    return f"{key}_in_{parts}"


def part_of(key, parts: int) -> Column:
    """The part of a key; null has one like any other value."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def layout_of(table: DataFrame) -> tuple[str, int] | None:
    """The key that ``table`` is laid out by and the number of its parts, or None."""
    for column in table.columns:
        found = re.fullmatch(r"(.+)_in_([1-9][0-9]*)", column)
        if found and found[1] in table.columns:
            return found[1], int(found[2])
    return None


def plain(table: DataFrame) -> DataFrame:
    """``table`` without the column of its layout."""
    layout = layout_of(table)
    return table.drop(part_column(*layout)) if layout else table


def laid_out(df: DataFrame, key: str, parts: int, tasks: int | None = None) -> DataFrame:
    """``df`` with the column of its parts, last, its rows in the order they are written.

    The rows are dealt to ``tasks`` by ranges of part, key and row, so that a key that
    holds much of the table is written by several of them.
    """
    name = part_column(key, parts)
    row = F.xxhash64(*df.columns)
    return (
        df.withColumn(name, part_of(key, parts))
        .repartitionByRange(tasks or parts, name, key, row)
        .sortWithinPartitions(name, key)
    )


def bloom_options(key: str) -> dict[str, str]:
    """Writer options: a Bloom filter on the key, of the size that its values need."""
    return {
        f"parquet.bloom.filter.enabled#{key}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
        "maxRecordsPerFile": str(FILE_ROWS),
    }


def write_laid_out(df: DataFrame, path: str, key: str, parts: int, mode: str = "errorifexists",
                   tasks: int | None = None, dealt: bool = False) -> None:
    """Write ``df`` as Parquet files at ``path``, laid out by ``key``.

    ``dealt`` says that each task has rows of one part, in order of the key: these are
    written as they come, without a shuffle and without a sort."""
    name = part_column(key, parts)
    rows = df.withColumn(name, part_of(key, parts)) if dealt else laid_out(df, key, parts, tasks)
    with _open_files(df.sparkSession, parts) if dealt else nullcontext():
        rows.write.mode(mode).options(**bloom_options(key)).partitionBy(name).parquet(path)


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def _open_files(spark: SparkSession, files: int) -> Iterator[None]:
    """A task that writes in here keeps a file open for each folder, up to ``files``, instead
    of sorting its rows by folder."""
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, files)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def rows_at(table: DataFrame, key: str, *values: Column) -> DataFrame:
    """The rows of ``table`` whose ``key`` is one of the given values, which are literals or
    built from them. Where the table is laid out by that key only their parts are read."""
    found = table.where(F.col(key).isin(*values) if values else F.lit(False))
    layout = layout_of(table)
    if values and layout and layout[0] == key:
        kind = table.schema[key].dataType
        parts = [part_of(value.cast(kind), layout[1]) for value in values]
        found = found.where(F.col(part_column(*layout)).isin(*parts))
    return plain(found)


def rows_with(table: DataFrame, key: str, values: Sequence) -> DataFrame:
    """The rows of ``table`` whose ``key`` is in a list of values."""
    return rows_at(table, key, *[F.lit(v) for v in dict.fromkeys(values) if v is not None])


def rows_of(table: DataFrame, key: str, asked: DataFrame, bound: int | None = None) -> DataFrame:
    """The rows of ``table`` whose ``key`` occurs in ``asked``.

    Where the table is laid out by that key, the parts of the keys asked for are found
    first, at most as many numbers as the table has parts, and only these are read.
    ``bound`` is a proven bound of the rows of ``asked``: when small, the keys are sent to
    the table, which then isn't shuffled. When larger they are stored first, so that Spark
    sees how few different ones there are. Without one Spark goes by the sizes it measures.
    """
    kind = table.schema[key].dataType
    keys = asked.select(F.col(key).cast(kind).alias(key)).where(F.col(key).isNotNull()).distinct()
    if bound is not None and bound > SMALL_ROWS:
        keys = staged(keys, "keys-asked-for")
    layout = layout_of(table)
    if layout and layout[0] == key:
        parts = keys.agg(F.collect_set(part_of(key, layout[1])).alias("parts")).first()["parts"]
        table = table.where(F.col(part_column(*layout)).isin(parts) if parts else F.lit(False))
    side = keys if bound is None else small_side(keys, bound)
    return plain(table.join(side, key, "left_semi"))
