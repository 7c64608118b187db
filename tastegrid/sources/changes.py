"""New ratings as a feed that outlives reloads of their table.

A feed is a folder with one change after the other, each put there in one step: of a load
the rows that the table before didn't have, of an ingest its rows. A stream over the feed
gets each new rating once, whatever version of the table it lies in, and goes on after a
restart where it was.
"""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import RATINGS, conform
from . import files, tables
from .streams import rating_message

# change=<version>, or change=<version>-<id of an ingest>
_CHANGE = re.compile(r"change=(.+_v[0-9]{20})(?:-(.+))?")


def last_version(spark: SparkSession, feed: str) -> str | None:
    """The version of the table that the feed has come to."""
    found = [_CHANGE.fullmatch(name) for name in files.folders(spark, feed)]
    return max((change[1] for change in found if change), default=None)


def added(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of ``new`` that ``old`` doesn't have, counted: of a row that is there three
    times and was there once, two. Equal rows are counted before the shuffle."""
    before = conform(old, RATINGS).groupBy(*RATINGS.names).agg(F.count("*").alias("had"))
    after = conform(new, RATINGS).groupBy(*RATINGS.names).agg(F.count("*").alias("has"))
    same = [after[c].eqNullSafe(before[c]) for c in RATINGS.names]
    more = after.join(before, same[0] & same[1] & same[2], "left").select(
        *[after[c] for c in RATINGS.names],
        (F.col("has") - F.coalesce("had", F.lit(0))).alias("more"),
    ).where("more > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("more")))
    return more.select(*RATINGS.names, times.alias("time")).drop("time")


def feed_load(spark: SparkSession, feed: str, version: str) -> None:
    """Add what the stored ``version`` has more than the version that the feed has come to.

    It is called between writing a version and pointing to it. When a load fails in
    between and is repeated, the repetition is compared with the version that was fed.
    """
    before = last_version(spark, feed)
    new = spark.read.table(version)
    rows = added(new, spark.read.table(before)) if before else conform(new, RATINGS)
    files.put(rows, f"{feed.rstrip('/')}/change={version}")


def feed_ingest(rows: DataFrame, feed: str, version: str, ingest_id: str | None = None) -> DataFrame:
    """Add the rows of an ingest into ``version``, once for an ``ingest_id``; returns the
    rows as they lie in the feed, for the table."""
    path = f"{feed.rstrip('/')}/change={version}-{ingest_id or uuid.uuid4().hex}"
    files.put(conform(rows, RATINGS), path)
    return rows.sparkSession.read.schema(RATINGS).parquet(path)


def fed_ratings(spark: SparkSession, feed: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The stream of new ratings, as messages."""
    rows = (
        spark.readStream.schema(RATINGS).option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", "true").parquet(feed)
    )
    return rows.select(rating_message("uid", "mid", "score").alias("value"))
