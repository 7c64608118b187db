"""Rating counts kept up to date: a partial count for each load and ingest, added up.

Below a folder each version of the ratings has its partial counts, ``<version>/<part>``,
each put there in one step and once. A part holds for every item of its rows how many there
are, and a sketch of who gave them. Sums and unions of parts are those of all rows, so
popular items need no look at the ratings.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.popularity import HOT_SCORE, places
from . import files

# Binary logarithm of a sketch's size, and the standard error of its estimate.
SKETCH, ERROR = 14, 0.0083
_PART = "mid int, n long, raters binary"


def partial_counts(ratings: DataFrame) -> DataFrame:
    """``(mid, n, raters)`` of some rows; rows without user count, but name no rater."""
    return ratings.where("mid is not null").groupBy("mid").agg(
        F.count("mid").alias("n"), F.hll_sketch_agg("uid", F.lit(SKETCH)).alias("raters")
    )


def add_part(rows: DataFrame, path: str, version: str, part: str) -> None:
    """Count ``rows`` of a version, once for the name ``part``."""
    files.put(partial_counts(rows), f"{path.rstrip('/')}/{version}/{part}")


def parts_of(spark: SparkSession, path: str, version: str) -> list[str]:
    return files.folders(spark, f"{path.rstrip('/')}/{version}")


def merged_counts(parts: DataFrame) -> DataFrame:
    """The partial counts of all rows of ``parts`` together."""
    return parts.groupBy("mid").agg(
        F.sum("n").alias("n"), F.hll_union_agg("raters").alias("raters")
    )


def counts_of(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``(mid, n, raters)`` of a version, ``raters`` about how many users rated the item."""
    names = [f"{path.rstrip('/')}/{version}/{part}" for part in parts_of(spark, path, version)]
    if not names:
        return spark.createDataFrame([], "mid int, n long, raters long")
    merged = merged_counts(spark.read.schema(_PART).parquet(*names))
    return merged.withColumn("raters", F.hll_sketch_estimate("raters"))


def places_of(counts: DataFrame, by_raters: bool = False) -> DataFrame:
    """The popular items ``(mid, score, n, place)`` from counts, or from the estimates of
    raters, as ``popular_places`` gives them from the ratings."""
    n = F.col("raters" if by_raters else "n")
    return places(counts.select("mid", F.lit(HOT_SCORE).alias("score"), n.alias("n")))
