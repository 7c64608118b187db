"""A third of all rows on one key: results stay whole and the work is split."""

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import lookup, popularity
from tastegrid.operators.joins import distinct_pairs_of
from tastegrid.operators.onboarding import validate_new_users
from tastegrid.operators.tiles import SIDE_MAX, groups_for, groups_for_square
from tastegrid.schemas import MOVIES, RATINGS, USERS, conform
from tastegrid.streaming import realtime

N = 200_000


@pytest.fixture
def hot_ratings(spark):
    """Every third rating is of item 0; users have few ratings each."""
    mid = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997)
    return conform(
        spark.range(0, N, numPartitions=8).select(
            (F.col("id") % 5000).alias("uid"), mid.alias("mid"), (F.col("id") % 5 + 1).alias("score")
        ), RATINGS)


@pytest.fixture
def small_tables_are_large(spark):
    """Thresholds at which these few rows count as big and skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_splits_the_hot_item(spark, hot_ratings, small_tables_are_large):
    users = conform(spark.range(5000).select("id", F.concat(F.lit("u"), "id").alias("username")), USERS)
    movies = conform(spark.range(1000).select("id", F.concat(F.lit("m"), "id").alias("movie_name")), MOVIES)
    df = lookup.rating_history(users, hot_ratings, movies)
    assert "skew=true" in final_plan(df)
    assert df.count() == N


def test_names_split_the_hot_request(spark, small_tables_are_large):
    name = F.when(F.col("id") % 3 == 0, F.lit("everybody wants it")).otherwise(
        F.concat(F.lit("name "), F.col("id").cast("string")))
    requests = spark.range(0, N, numPartitions=8).select(F.col("id").alias("request_id"), name.alias("username"))
    users = conform(spark.range(10).select("id", F.concat(F.lit("name "), "id").alias("username")), USERS)
    df = validate_new_users(requests, users)
    assert "skew=true" in final_plan(df)
    verdicts = {r["reason"]: r["n"] for r in df.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    hot = N // 3 + 1
    registered = sum(1 for i in range(10) if i % 3)
    assert verdicts == {"duplicate": hot - 1, "registered": registered, None: N - hot - registered + 1}


def test_counts_are_combined_before_the_shuffle(hot_ratings):
    """What crosses the shuffle is one row per item and map task."""
    plan = final_plan(popularity.rating_counts(hot_ratings))
    assert "partial_count" in plan
    counts = {r["mid"]: r["n"] for r in popularity.hot_items(hot_ratings, 1).collect()}
    assert counts == {0: sum(1 for i in range(N) if i % 3 == 0 or i % 997 == 0)}


def test_history_of_a_hot_user_is_spread(spark, small_tables_are_large):
    """A third of the ratings are one user's: they are read in many parts."""
    uid = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).cast("int")
    seen = spark.range(0, N, numPartitions=8).select(uid.alias("uid"), (F.col("id") % 3001).cast("int").alias("mid"))
    asked = spark.createDataFrame([(0, 5), (0, 6), (1, 5)], "uid int, mid int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = distinct_pairs_of(seen, asked, "uid", "mid")
    want = {(0 if i % 3 == 0 else i % 5000, i % 3001) for i in range(N)}
    want = {p for p in want if p[0] in (0, 1)}
    got = df.withColumn("part", F.spark_partition_id()).collect()
    assert {(r["uid"], r["mid"]) for r in got} == want and len(got) == len(want)
    assert len({r["part"] for r in got if r["uid"] == 0}) > 4


@pytest.mark.parametrize("unseen", [False, True])
def test_answers_split_the_hot_message(spark, small_tables_are_large, unseen):
    """A third of the messages are one user rating one item again and again."""
    hot = F.col("id") % 3 == 0
    messages = conform(spark.range(0, N, numPartitions=8).select(
        F.when(hot, 7).otherwise(F.col("id") % 5000).alias("uid"),
        F.when(hot, 1).otherwise(F.col("id") % 997).alias("mid"),
        (F.rand(3) * 5).alias("score")), RATINGS)
    lists = spark.range(500).select(
        F.col("id").cast("int").alias("mid"), F.lit(0).alias("start"),
        F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(
            (F.col("id") + i).cast("int").alias("mid"), (1 - i / 10).cast("double").alias("score"))
        ).alias("recs"))
    popular = spark.createDataFrame([(m, 5.0, 100 - m) for m in range(5)], "mid int, score double, n long")
    seen = spark.createDataFrame([(7, 2, 1.0), (7, 4, 1.0)], RATINGS)
    df = realtime.realtime_recs(messages, lists, popular, seen=seen if unseen else None)
    assert "skew=true" in final_plan(df)
    assert df.count() == N
    recs = {r["recs"] for r in df.where("uid = 7 and mid = 1").select("recs").distinct().collect()}
    assert recs == {"3,5,6,7,8" if unseen else "2,3,4,5,6"}


def test_tiles_are_bounded_whatever_the_size():
    for n in (0, 1, 1000, 50_000, 10_000_000, 2_000_000_000):
        for workers in (1, 8, 8000):
            assert n / groups_for_square(n, workers) <= SIDE_MAX
            assert n / groups_for(n, workers) <= SIDE_MAX
    assert groups_for_square(1_000_000, 8000) ** 2 / 2 >= 8000
