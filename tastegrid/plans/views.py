"""The logical tables, derived from the given ones. Every view takes whole tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import FACTORS, MOVIES, RATINGS, USERS, conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per order line: quantity 1..50 becomes a score 1..5."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_partkey", "l_quantity"
    )
    return conform(
        lines.join(orders, "key").select(
            F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("mid"),
            (F.floor((F.col("l_quantity") - 1) / 10) + 1).alias("score"),
        ),
        RATINGS,
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under a name of their own."""
    name = F.concat_ws(" #", "p_name", F.col("p_partkey").cast("string"))
    return conform(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"),
                                            name.alias("movie_name")), MOVIES
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under their plain names, which many of them share."""
    return conform(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"),
                                            F.col("p_name").alias("movie_name")), MOVIES
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"),
                                                F.col("c_name").alias("username")), USERS
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"),
                                                  F.col("embedding").alias("features")), FACTORS
    )


def event_item() -> Column:
    return F.floor(F.col("value") * 5).cast("int")


def event_score() -> Column:
    return (F.pmod(F.floor("value"), F.lit(5)) + 1).cast("int")


def event_messages(events: DataFrame) -> DataFrame:
    """Rating messages ``(event_id, value)`` in the forms a source may send: plain,
    quoted, with a decimal score, with extra fields, and two that do not parse."""
    uid, mid, score = (
        c.cast("string") for c in (F.col("user_id"), event_item(), event_score())
    )
    quote = F.lit('"')
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.concat_ws(",", uid, kind, score))
        .when(kind == "signup", uid)
        .when(kind == "view", F.concat_ws(
            ",", *[F.concat(quote, part, quote) for part in (uid, mid, score)]))
        .when(kind == "click", F.concat_ws(",", uid, mid, F.concat(score, F.lit(".5"))))
        .otherwise(F.concat_ws(",", uid, mid, score, kind))
    )
    return events.select("event_id", text.alias("value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(table(spark, sf_dir, "events"))


def rating_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by user name; error events come from a name nobody has."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(name)
        .alias("username"),
        event_item().alias("mid"), event_score().cast("double").alias("score"),
    )


def registered_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with money in their account are the users known so far."""
    rich = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return conform(
        rich.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username")), USERS
    )


def name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for user names: customer names, part names (each many times),
    language codes (too short) and page addresses (too long)."""
    sources = [
        ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"),
        ("documents", "doc_id", "lang"), ("pages", "page_id", "url"),
    ]
    parts = [
        table(spark, sf_dir, name).select(
            (F.col(key).cast("bigint") * len(sources) + place).alias("request_id"),
            F.col(text).alias("username"),
        )
        for place, (name, key, text) in enumerate(sources)
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
