"""Lists without rated items, and popular items where a user has no list."""

from pyspark.sql import DataFrame, functions as F

from .popularity import hot_list


def exclude_seen(candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    """``candidates (uid, mid, ...)`` without pairs the user has already rated.

    Repeated ratings are dropped before the shuffle the join needs anyway.
    """
    rated = ratings.select("uid", "mid").distinct()
    return candidates.join(rated, ["uid", "mid"], "left_anti")


def user_recs_with_fallback(users: DataFrame, user_recs: DataFrame,
                            hot: DataFrame, k: int = 10) -> DataFrame:
    """A list for every user ``(uid, recs, is_fallback)``: the user's own, or the ``k``
    most popular items for a user the model does not know."""
    joined = users.select(F.col("id").alias("uid")).join(user_recs, "uid", "left")
    return joined.select(
        "uid",
        F.coalesce("recs", hot_list(hot, k, with_scores=True)).alias("recs"),
        F.col("recs").isNull().alias("is_fallback"),
    )
