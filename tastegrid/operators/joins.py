"""Joins whose sides are known to be small, or whose keys may be hot."""

from pyspark.sql import DataFrame, functions as F

# Rows of a side that may be sent to every executor: a few MB at most.
SMALL_ROWS = 10_000
# Parts a hot key's rows are spread over.
SALTS = 32


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when ``rows``, its proven row bound, is small.

    Without a bound the mark is left off: Spark then decides by the sizes it
    measures, and splits hot keys of a shuffled join at run time.
    """
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def distinct_pairs_of(pairs: DataFrame, keys: DataFrame, key: str, other: str) -> DataFrame:
    """The distinct ``(key, other)`` of ``pairs`` whose ``key`` occurs in ``keys``.

    One key may hold much of ``pairs``. Its rows are spread by ``other`` over
    ``SALTS`` parts, and each wanted key is copied to them all; equal pairs meet in
    the same part, so that they are dropped there without a further shuffle.
    """
    salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    wanted = keys.select(key).distinct().withColumn("salt", F.explode(salts))
    return (
        pairs.select(key, other, salt.alias("salt"))
        .join(wanted, [key, "salt"], "left_semi")
        .distinct().drop("salt")
    )
