"""Streaming sources: message topics and newly appended ratings."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import RATINGS


def kafka_messages(spark: SparkSession, servers: str, topic: str = "recommend",
                   starting_offsets: str = "latest",
                   max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Messages of a Kafka topic as ``value string``; needs the Kafka connector package.

    ``starting_offsets`` holds for the first start only; after that the query's
    checkpoint says where to go on.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return rating_stream(reader.load())


def rating_stream(source: DataFrame) -> DataFrame:
    """The message text of any streaming source with a ``value`` column."""
    return source.select(F.col("value").cast("string").alias("value"))


def ratings_change_stream(spark: SparkSession, path: str,
                          max_files_per_trigger: int = 1000) -> DataFrame:
    """Ratings appended to the files at ``path``, as messages."""
    changes = (
        spark.readStream.schema(RATINGS)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )
    return changes.select(rating_message("uid", "mid", "score").alias("value"))


def rating_message(uid, mid, score) -> Column:
    """A rating as message text ``uid,mid,score``; a missing field stays in its place."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (uid, mid, score)]
    return F.concat_ws(",", *fields)
