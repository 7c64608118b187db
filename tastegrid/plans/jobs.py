"""The four jobs end to end: load, offline, tune, stream.

Tables keep the names of the serving side. Each run writes new versions of its
tables, below a ``root`` folder when one is given, and then points the names there: a
query that is reading the previous run is not disturbed.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import fallback, model, popularity
from ..session import staged
from ..sources import changes, counts as rating_parts, streams, tables
from ..streaming import realtime
from ..streaming.served import ServedLog

# Table names.
RATINGS, USER_RECS, MOVIE_RECS, HOT, SERVED_RECS, TUNING, RUN = (
    "ratings", "userRecs", "movieRecs", "hotMovies", "servedUserRecs", "tuningResults",
    "offlineRun",
)


def _place(root: str | None, name: str) -> str | None:
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}" if root else None


def load(spark: SparkSession, csv_path: str, root: str | None = None,
         buckets: int = 0, parts: int = 0, feed: str | None = None,
         counts: str | None = None) -> DataFrame:
    """Ratings CSV to the table ``ratings``, in buckets of users, or in parts of users that
    lookups can skip, when asked. What the table before didn't have goes to the folder
    ``feed``, when one is given, for streams of new ratings; the ratings per item go to the
    folder ``counts``, for ``refresh_hot``."""
    version = tables.write_version(
        tables.load_ratings_csv(spark, csv_path), RATINGS, _place(root, RATINGS),
        "uid" if buckets else None, buckets, "uid" if parts else None, parts,
    )
    if feed:
        changes.feed_load(spark, feed, version)
    if counts:
        rating_parts.add_part(spark.read.table(version), counts, version, "load")
    tables.point_to(spark, {RATINGS: version})
    return tables.read_table(spark, RATINGS)


def offline(spark: SparkSession, root: str | None = None, k: int = 10,
            threshold: float = 0.7, exclude_seen: bool = False,
            users: DataFrame | None = None, neighbours: int | None = None,
            buckets: int = 0, parts: int = 0, **als) -> None:
    """Fit on ``ratings``; write user lists, neighbour lists and popular items.

    ``neighbours`` keeps the first so many neighbours per item, enough for a stream
    that leaves nothing out; by default the whole lists are kept, which a stream that
    leaves out rated items needs. With ``users`` everybody
    gets a list, the popular items where the model knows nothing. With ``buckets``
    the neighbour lists are laid out by item, and the stream joins them unshuffled; with
    ``parts`` a batch of the stream reads those of its items only.

    The tables of a run are pointed to together, when all of them are written.
    """
    ratings = tables.read_table(spark, RATINGS)
    fitted = model.fit_als(ratings, **als)
    versions = {}

    def write(df: DataFrame, name: str, *more) -> DataFrame:
        versions[name] = tables.write_version(df, name, _place(root, name), *more)
        return spark.read.table(versions[name])

    hot = write(popularity.popular_places(ratings), HOT)
    lists = write(model.user_topn(fitted, k, ratings if exclude_seen else None), USER_RECS)
    write(
        model.model_similar_items(fitted, threshold, neighbours), MOVIE_RECS,
        "mid" if buckets else None, buckets, "mid" if parts else None, parts,
    )
    if users is not None:
        lists = fallback.user_recs_with_fallback(users, lists, hot, k)
    write(tables.publish_user_recs(lists), SERVED_RECS)
    write(spark.createDataFrame([(neighbours,)], "neighbours int"), RUN)
    tables.point_to(spark, versions)


def ingest(spark: SparkSession, requests: DataFrame, users: DataFrame,
           rejects: str | None = None, feed: str | None = None,
           counts: str | None = None, ingest_id: str | None = None) -> None:
    """Append ``requests (username, mid, score)`` to ``ratings``; those of unknown names
    are appended to the folder ``rejects`` when one is given. The new ratings go to the
    folder ``feed`` and their counts to ``counts``, when given, once for an ``ingest_id``."""
    ingest_id = ingest_id or uuid.uuid4().hex

    def handed_on(rows: DataFrame, version: str) -> DataFrame:
        rows = changes.feed_ingest(rows, feed, version, ingest_id) if feed else staged(rows, "ingest")
        if counts:
            rating_parts.add_part(rows, counts, version, ingest_id)
        return rows

    unknown = tables.ingest_into(requests, users, RATINGS, handed_on if feed or counts else None)
    if rejects:
        unknown.write.mode("append").parquet(rejects)


def refresh_hot(spark: SparkSession, counts: str, root: str | None = None) -> None:
    """Write the table of popular items from the counts of the ratings as they are now,
    without a look at the ratings themselves."""
    version = tables.current_version(spark, RATINGS)
    found = rating_parts.places_of(rating_parts.counts_of(spark, counts, version))
    tables.save_table(found, HOT, _place(root, HOT))


def tune(spark: SparkSession, root: str | None = None, rungs: bool = False, **grid) -> DataFrame:
    """Grid search on ``ratings``; returns the best point. With ``rungs`` points that do
    badly after a few iterations are left out, and the stored results are the last rung's."""
    ratings = tables.read_table(spark, RATINGS)
    if rungs:
        found = model.rung_search(ratings, **grid)
        last = found.agg({"iterations": "max"}).first()[0]
        results = found.where(found["iterations"] == last).drop("iterations")
    else:
        results = model.grid_search(ratings, **grid)
    tables.save_table(results, TUNING, _place(root, TUNING))
    return model.best_params(tables.read_table(spark, TUNING))


def stream(spark: SparkSession, messages: DataFrame, sink, checkpoint: str,
           reject_sink=None, exclude_seen: bool = False, min_score: float | None = None,
           trigger: dict | None = None, keyed: bool = False, blocks: int = 1) -> StreamingQuery:
    """Answer rating messages from the tables of the latest offline run.

    With ``exclude_seen`` the lists must be whole; a run that cut them is refused.
    A run's tables never change, so only ``ratings``, which grows, is listed anew; or it is
    read once, at the first start, when the stream is ``keyed`` and keeps what users have
    rated as its own state.
    """
    if exclude_seen and tables.read_table(spark, RUN).first()["neighbours"] is not None:
        raise ValueError("the neighbour lists are cut; run offline without neighbours")
    static = realtime.Tables(
        movie_recs=lambda: tables.read_table(spark, MOVIE_RECS, with_layout=True),
        hot=lambda: tables.read_table(spark, HOT),
        sink=sink, reject_sink=reject_sink,
        ratings=(
            lambda: tables.read_table(spark, RATINGS, latest=True, with_layout=True)
        ) if exclude_seen else None,
        min_score=min_score,
    )
    if keyed:
        if not exclude_seen:
            raise ValueError("a keyed stream leaves out rated items: give exclude_seen")
        return realtime.start_keyed(messages, static, checkpoint, trigger, blocks)
    return realtime.start_realtime(messages, static, checkpoint, trigger)


def kafka_stream(spark: SparkSession, servers: str, topic: str, out: str,
                 starting_offsets: str = "latest", max_offsets: int | None = None,
                 jdbc_url: str | None = None, jdbc_table: str = SERVED_RECS,
                 exclude_seen: bool = False, min_score: float | None = None,
                 keyed: bool = False) -> StreamingQuery:
    """The stream job on a Kafka topic. Checkpoint and rejects lie below the folder
    ``out``; the answers too, as a ``ServedLog``, or in a database table where ``jdbc_url``
    is given."""
    log = ServedLog(spark, f"{out}/recs", ServedLog.number_of(spark, f"{out}/recs", f"{out}/checkpoint"))
    answers = log.sink
    if jdbc_url:
        answers = realtime.jdbc_sink(jdbc_url, jdbc_table, log=f"{out}/appended")
    return stream(
        spark, streams.kafka_messages(spark, servers, topic, starting_offsets, max_offsets),
        answers, f"{out}/checkpoint", realtime.batch_folder_sink(f"{out}/rejects"),
        exclude_seen=exclude_seen, min_score=min_score, keyed=keyed,
    )
