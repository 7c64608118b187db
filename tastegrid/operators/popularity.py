"""Most rated items and rating histograms."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from ..sources.layout import rows_with
from .joins import small_side

# The scores every histogram shows, and the score of a hot item.
HISTOGRAM_SCORES = [1.0, 2.0, 3.0, 4.0, 5.0]
HOT_SCORE = 5.0


def rating_counts(ratings: DataFrame, distinct_users: bool = False) -> DataFrame:
    """Ratings per item ``(mid, n)``, or raters per item with ``distinct_users``."""
    n = F.count_distinct("uid") if distinct_users else F.count("mid")
    return ratings.where(F.col("mid").isNotNull()).groupBy("mid").agg(n.alias("n"))


def _most_rated(ratings: DataFrame, k: int, distinct_users: bool) -> DataFrame:
    counts = rating_counts(ratings, distinct_users)
    return counts.orderBy(F.desc("n"), "mid").limit(k)


def hot_items(ratings: DataFrame, k: int = 5, distinct_users: bool = False) -> DataFrame:
    """The ``k`` most rated items ``(mid, score, n)``; equal counts by item id."""
    top = _most_rated(ratings, k, distinct_users)
    return top.select("mid", F.lit(HOT_SCORE).alias("score"), "n")


def places(counted: DataFrame, *order: Column) -> DataFrame:
    """``counted (mid, n, ...)`` with the ``place`` of each item by popularity, from 1; or
    any rows in the given ``order``.

    The rows are sorted by range, and only the sizes of the ranges meet in one task.
    """
    ordered = staged(
        counted.orderBy(*(order or (F.desc("n"), "mid")))
        .withColumn("at", F.monotonically_increasing_id()),
        "popularity",
    )
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    inside = F.col("at") - F.shiftleft("part", 33)
    return (
        ordered.withColumn("part", part).join(starts, "part")
        .withColumn("place", (F.col("start") + inside + 1).cast("long"))
        .drop("part", "start", "at")
    )


def popular_places(ratings: DataFrame, distinct_users: bool = False) -> DataFrame:
    """Every rated item by popularity ``(mid, score, n, place)``."""
    counts = rating_counts(ratings, distinct_users)
    return places(counts.select("mid", F.lit(HOT_SCORE).alias("score"), "n"))


def hot_list(hot: DataFrame, k: int, with_scores: bool = False) -> Column:
    """The ``k`` hottest items as one array value, most rated first, for any query.

    A scalar subquery: Spark runs it once and hands out the single value.
    """
    hot = hot.orderBy(F.desc("n"), "mid").limit(k)
    entry = F.struct((-F.col("n")).alias("order"), "mid", "score")
    ordered = F.array_sort(F.collect_list(entry))
    value = F.transform(
        ordered,
        (lambda e: F.struct(e["mid"].alias("mid"), e["score"].alias("score")))
        if with_scores else (lambda e: e["mid"]),
    )
    return hot.agg(value.alias("hot")).scalar()


def popular_movies(ratings: DataFrame, movies: DataFrame, k: int = 10,
                   distinct_users: bool = False) -> DataFrame:
    """The ``k`` most rated items with their names ``(mid, movie_name, n)``.

    The cut comes before the join, so an item without a name leaves fewer rows.
    """
    top = small_side(_most_rated(ratings, k, distinct_users), k)
    named = movies.join(top, movies["id"] == top["mid"])
    return named.select("mid", "movie_name", "n").orderBy(F.desc("n"), "mid").limit(k)


def rating_histogram(ratings: DataFrame, mid: int | None = None) -> DataFrame:
    """Ratings per score ``(score, n)``, of one item or of all together.

    Scores 1 to 5 always appear; any other score appears when it was given.
    """
    if mid is not None:
        ratings = rows_with(ratings, "mid", [mid])
    counts = ratings.groupBy("score").agg(F.count("uid").alias("n"))
    shown = ratings.sparkSession.range(1).select(
        F.explode(F.lit(HISTOGRAM_SCORES)).alias("score"), F.lit(0).cast("bigint").alias("n")
    )
    return counts.unionByName(shown).groupBy("score").agg(F.sum("n").alias("n"))


def rating_histograms_all(ratings: DataFrame) -> DataFrame:
    """The histogram of every rated item ``(mid, score, n)``.

    The ratings are counted before their shuffle; the zero counts are added to those
    counts, which are summed once more.
    """
    counts = (
        ratings.where(F.col("mid").isNotNull())
        .groupBy("mid", "score").agg(F.count("uid").alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    entries = F.array(
        F.struct(F.col("score").alias("score"), F.col("n").alias("n")),
        *[F.struct(F.lit(s).alias("score"), zero.alias("n")) for s in HISTOGRAM_SCORES],
    )
    return (
        counts.select("mid", F.explode(entries).alias("e"))
        .groupBy("mid", F.col("e.score").alias("score"))
        .agg(F.sum("e.n").alias("n"))
    )
