"""Lookups by name and key, rating history, and reading recommendation lists.

Joins against ``users`` and ``movies`` carry no broadcast hint unless the side
has a proven row bound: Spark broadcasts a table whose measured size allows it,
and otherwise splits hot keys of the shuffled side at run time. Where a table is laid
out by the key asked for (``sources.layout``), only the parts of the keys are read.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import digits_to_id
from ..sources.layout import layout_of, plain, rows_at, rows_of, rows_with
from .joins import small_side


def resolve_users(users: DataFrame, names: DataFrame | Sequence[str]) -> DataFrame:
    """Ids of registered names ``(username, uid)``; unknown names drop out.

    ``names`` is a list, or a DataFrame with a ``username`` column.
    """
    if isinstance(names, DataFrame):
        known = users.select("username", F.col("id").alias("uid"))
        return known.join(names.select("username").distinct(), "username")
    return rows_with(users, "username", names).select("username", F.col("id").alias("uid"))


def movie_names(movies: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Names of item ids ``(mid, movie_name)``; unknown ids drop out."""
    if isinstance(ids, DataFrame):
        named = movies.select(F.col("id").alias("mid"), "movie_name")
        return named.join(ids.select("mid").distinct(), "mid")
    return rows_with(movies, "id", ids).select(F.col("id").alias("mid"), "movie_name")


def search_movies(movies: DataFrame, names: DataFrame | str) -> DataFrame:
    """Items of exactly this name ``(movie_name, mid)``, smallest id first.

    With a DataFrame of names (column ``movie_name``) the answer is one row per
    name: its smallest id and how many items bear it.
    """
    if isinstance(names, DataFrame):
        first = movies.groupBy("movie_name").agg(
            F.min("id").alias("mid"), F.count("id").alias("matches")
        )
        return first.join(names.select("movie_name").distinct(), "movie_name")
    found = rows_with(movies, "movie_name", [names])
    return found.select("movie_name", F.col("id").alias("mid")).orderBy("mid")


def get_by_id(table: DataFrame, record_id) -> DataFrame:
    """The row of ``table`` with this primary key, or none.

    The key is a number or a text of digits; any other text finds nothing. With a
    DataFrame of texts (column ``record_id``) each found row keeps its request.
    """
    if isinstance(record_id, DataFrame):
        wanted = record_id.select("record_id", digits_to_id(F.col("record_id")).alias("id"))
        return wanted.where(F.col("id").isNotNull()).join(plain(table), "id")
    if isinstance(record_id, str):
        key = digits_to_id(F.lit(record_id))
    elif isinstance(record_id, (int, float)):
        key = F.lit(int(record_id))
    else:
        key = F.lit(None).cast("int")
    return rows_at(table, "id", key)


def rating_history(users: DataFrame, ratings: DataFrame, movies: DataFrame,
                   usernames: Sequence[str] | None = None) -> DataFrame:
    """Every rating with user and item name ``(username, mid, movie_name, score)``.

    Ratings of items without a name are left out. ``usernames`` picks users; a
    name is unique, so the picked side has at most one row per name.
    """
    who = users.select(F.col("id").alias("uid"), "username")
    if usernames is not None:
        who = small_side(who.where(F.col("username").isin(list(usernames))), len(usernames))
        ratings = rows_of(ratings, "uid", who, len(usernames))
    what = movies.select(F.col("id").alias("mid"), "movie_name")
    return (
        ratings.select("uid", "mid", "score")
        .join(who, "uid").join(what, "mid")
        .select("username", "mid", "movie_name", "score")
    )


def rec_names(served: DataFrame, movies: DataFrame, recs: str) -> DataFrame:
    """The listed items with names: the columns of ``served`` without the list,
    then ``position`` (from 1), ``rec_mid`` and ``rec_name``.

    Items without a name are left out; ids and names always belong together, and
    ``position`` keeps the order of the list.
    """
    keys = [c for c in served.columns if c != recs]
    listed = served.select(*keys, F.posexplode(F.split(recs, ",")).alias("pos", "field"))
    ids = listed.select(
        *keys, (F.col("pos") + 1).alias("position"),
        F.col("field").try_cast("int").alias("rec_mid"),
    )
    named = movies.select(F.col("id").alias("rec_mid"), F.col("movie_name").alias("rec_name"))
    return ids.join(named, "rec_mid").select(*keys, "position", "rec_mid", "rec_name")


def user_recommendations(users: DataFrame, user_recs: DataFrame, movies: DataFrame,
                         usernames: Sequence[str] | None = None) -> DataFrame:
    """Offline lists by user name, with item names
    ``(username, position, rec_mid, rec_name)``."""
    who = users.select(F.col("id").alias("uid"), "username")
    if usernames is not None:
        who = small_side(who.where(F.col("username").isin(list(usernames))), len(usernames))
    lists = user_recs.select("uid", "midrecs").join(who, "uid").select("username", "midrecs")
    return rec_names(lists, movies, "midrecs")


def latest_recs(served: DataFrame) -> DataFrame:
    """The row of the latest batch per (uid, mid) ``(uid, mid, recs, batch_id)``."""
    return served.groupBy("uid", "mid").agg(
        F.max_by("recs", "batch_id").alias("recs"), F.max("batch_id").alias("batch_id")
    )


def realtime_lookup(requests: DataFrame, users: DataFrame, served: DataFrame,
                    movies: DataFrame) -> DataFrame:
    """Real-time recommendations for ``requests (username, mid)``, with names
    ``(username, mid, batch_id, position, rec_mid, rec_name)``.

    The served rows are cut to those asked for before the latest is taken.
    """
    asked = requests.select("username", "mid").distinct().join(
        users.select("username", F.col("id").alias("uid")), "username"
    )
    if layout_of(served):
        served = rows_of(served, "uid", asked)
    wanted = served.join(asked.select("uid", "mid"), ["uid", "mid"], "left_semi")
    answers = latest_recs(wanted).join(asked, ["uid", "mid"])
    return rec_names(answers.select("username", "mid", "batch_id", "recs"), movies, "recs")
