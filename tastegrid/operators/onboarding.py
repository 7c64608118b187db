"""Checking new user names in batches."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import name_length_ok


def validate_new_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """A verdict per request ``(request_id, username, accepted, reason)``.

    A name is required, has 3 to 25 characters and must not be registered. Of
    several requests for one free name the first (smallest ``request_id``) gets it.

    A name asked for very often stays spread: its first request is found by a
    combined count and matched by request id, and the join with the registered
    names has a plain shuffle on both sides, which Spark splits where it is skewed.
    """
    name = F.col("username")
    checked = requests.select(
        "request_id", "username",
        F.when(name.isNull() | (F.trim(name) == ""), "missing")
        .when(~name_length_ok(name), "length").alias("fault"),
    )
    faulty = checked.where(F.col("fault").isNotNull()).select(
        "request_id", "username", F.lit(False).alias("accepted"), F.col("fault").alias("reason")
    )
    fit = checked.where(F.col("fault").isNull()).drop("fault")
    first = (
        fit.groupBy("username").agg(F.min("request_id").alias("request_id"))
        .select("request_id", F.lit(True).alias("first"))
    )
    known = users.select("username", F.lit(True).alias("registered"))
    reason = F.when(F.col("registered"), "registered").when(F.col("first").isNull(), "duplicate")
    judged = fit.join(first, "request_id", "left").join(known, "username", "left").select(
        "request_id", "username", reason.isNull().alias("accepted"), reason.alias("reason")
    )
    return judged.unionByName(faulty)


def new_user_names(verdicts: DataFrame) -> DataFrame:
    """The accepted names, one row each."""
    return verdicts.where("accepted").select("username")
