"""Batch sources and sinks: rating files, catalogue tables, served tables."""

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import ids_to_text
from ..schemas import RATINGS, SERVED_USER_RECS, conform
from . import layout


def load_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ratings from CSV with a header line; a cell that does not parse is null."""
    return spark.read.csv(path, header=True, schema=RATINGS, enforceSchema=True)


def save_table(df: DataFrame, name: str, path: str | None = None,
               bucket_by: str | None = None, buckets: int = 0,
               lay_out_by: str | None = None, parts: int = 0) -> None:
    """Write ``df`` as a new version of the table ``name``, below ``path`` when given.

    A version is written whole under a name of its own; then the view ``name`` is
    pointed to it in one step. A reader finds the last whole version at any time, also
    during a write and after one that failed. The version before is kept for readers
    that still use it; older ones are dropped (files below ``path`` stay, as the
    catalogue doesn't own them).

    With ``bucket_by`` the rows are laid out by that key, one file per bucket, so
    that later joins on the key need no shuffle and a lookup of one key reads one
    bucket. With ``lay_out_by`` they lie in ``parts`` folders by that key, as
    ``sources.layout`` says: reads of some keys skip the rest, and a key that holds much
    of the table is written by several tasks.
    """
    version = write_version(df, name, path, bucket_by, buckets, lay_out_by, parts)
    point_to(df.sparkSession, {name: version})


def write_version(df: DataFrame, name: str, path: str | None = None,
                  bucket_by: str | None = None, buckets: int = 0,
                  lay_out_by: str | None = None, parts: int = 0) -> str:
    """Write ``df`` as a version of ``name`` that nothing points to yet; returns its name."""
    if bucket_by:
        df = df.repartition(buckets, bucket_by)
    elif lay_out_by:
        df = layout.laid_out(df, lay_out_by, parts)
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    elif lay_out_by:
        writer = writer.options(**layout.bloom_options(lay_out_by)).partitionBy(
            layout.part_column(lay_out_by, parts))
    version = f"{name}_v{time.time_ns():020d}"
    if path:
        writer = writer.option("path", f"{path.rstrip('/')}/{version}")
    writer.saveAsTable(version)
    return version


def point_to(spark: SparkSession, versions: dict[str, str]) -> None:
    """Point each table name to its new version. All versions are there before the first
    name is moved, so tables that belong together are apart for a moment only."""
    for name in versions:
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
            spark.sql(f"ALTER TABLE {name} RENAME TO {name}_v{0:020d}")
    for name, version in versions.items():
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for name in versions:
        for old in table_versions(spark, name)[:-2]:
            spark.sql(f"DROP TABLE IF EXISTS {old}")


def table_versions(spark: SparkSession, name: str) -> list[str]:
    """The stored versions of the table ``name``, oldest first."""
    own = re.compile(rf"{re.escape(name.lower())}_v[0-9]{{20}}")
    tables = (t.name for t in spark.catalog.listTables() if not t.isTemporary)
    return sorted(t for t in tables if own.fullmatch(t.lower()))


def current_version(spark: SparkSession, name: str) -> str:
    """The version that the name points to: not always the newest, when a write has failed
    before its end."""
    about = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'View Text'").first()
    return re.fullmatch(r"SELECT \* FROM (\S+)", about["data_type"].strip())[1]


def read_table(spark: SparkSession, name: str, latest: bool = False,
               with_layout: bool = False) -> DataFrame:
    """The table ``name``; with ``latest``, as another application left it last. The column
    of its layout, if it has one, is given ``with_layout`` only: lookups need it."""
    if latest:
        spark.catalog.refreshTable(name)
    table = spark.read.table(name)
    return table if with_layout else layout.plain(table)


def resolve_rating_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Rating rows for ``requests (username, mid, score)`` of known users."""
    ids = users.select("username", F.col("id").alias("uid"))
    return conform(requests.join(ids, "username"), RATINGS)


def ingest_ratings(requests: DataFrame, users: DataFrame, path: str) -> None:
    """Append the ratings of known users to the ratings files at ``path``.

    Requests from unknown names are left out: they have no user id to store.
    """
    resolve_rating_requests(requests, users).write.mode("append").parquet(path)


def ingest_into(requests: DataFrame, users: DataFrame, name: str,
                feed: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Append the ratings of known users to the stored table ``name``, in the layout that
    it has, buckets included. Returns the requests of unknown names, which have no user
    id to store. ``feed`` is given the rows and the version that they go into first, and
    returns the rows to store."""
    spark = requests.sparkSession
    version = current_version(spark, name)
    rows, target = resolve_rating_requests(requests, users), spark.read.table(version)
    if feed:
        rows = feed(rows, version)
    laid_out_by = layout.layout_of(target)
    if laid_out_by:
        rows = layout.laid_out(rows, *laid_out_by).select(target.columns)
    rows.write.options(**(layout.bloom_options(laid_out_by[0]) if laid_out_by else {})).insertInto(version)
    return requests.join(users.select("username"), "username", "left_anti")


def publish_user_recs(user_recs: DataFrame) -> DataFrame:
    """The serving form of the offline lists: one text of ids per user."""
    ids = F.transform("recs", lambda rec: rec["mid"])
    return conform(
        user_recs.select("uid", ids_to_text(ids).alias("midrecs")), SERVED_USER_RECS
    )


def write_recs_jdbc(recs: DataFrame, url: str, table: str,
                    properties: dict[str, str] | None = None,
                    batch_size: int = 5000) -> None:
    """Append served rows over JDBC, one connection per partition.

    The rows carry their ``batch_id``: a replayed batch adds equal rows, and the
    readers take one row of the latest batch, so a retry changes no answer.
    """
    options = {"batchsize": str(batch_size), **(properties or {})}
    recs.write.jdbc(url, table, mode="append", properties=options)
