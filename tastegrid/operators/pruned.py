"""Best items per user, exact, without the groups of items that can't hold any of them.

Items are grouped by the length of their vectors, longest first. The first group gives
each user a k-th best score; no item of a later group can reach it where the user's length
times the greatest length of the group stays below (Cauchy and Schwarz). Users go only to
the groups that are left to them, and a tile that no user goes to is not made.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocks import SLACK
from ..functions.vectors import norm
from ..session import staged
from .joins import small_side
from .popularity import places
from .tiles import group_of, groups_for, workers_of
from .topn import USER_SIDE_MAX, best_in_tiles, item_blocks, seen_of_users, user_lists

# Items of a group: fewer than in a full product, since a group is skipped as a whole.
GROUP = 4096


@dataclass
class Pruned:
    """``scores (uid, mid, score, rank)``, and how many of the (user, group of items) pairs
    there are and were computed."""

    scores: DataFrame
    pairs: int
    computed: int


def grouped_items(item_factors: DataFrame, side: int = GROUP) -> DataFrame:
    """``(id, features, length, ig)``: group 0 has the ``side`` longest vectors, and so on.
    Equally long ones are told apart by id, so no group is larger."""
    there = F.col("id").isNotNull() & F.col("features").isNotNull()
    items = item_factors.where(there).select(
        F.col("id").cast("int").alias("id"), "features", norm("features").alias("length")
    )
    placed = places(items, F.desc("length"), F.col("id"))
    group = ((F.col("place") - 1) / side).cast("int")
    return staged(placed.select("id", "features", "length", group.alias("ig")), "item-groups")


def _seen(exclude: DataFrame | None, tiles: DataFrame) -> DataFrame | None:
    """What the users of ``tiles (tile, id)`` have rated."""
    if exclude is None:
        return None
    return tiles.select("tile", "id").distinct().join(seen_of_users(exclude), "id")


def pruned_scores(user_factors: DataFrame, item_factors: DataFrame, k: int = 10,
                  exclude: DataFrame | None = None, side: int = GROUP,
                  user_groups: int | None = None) -> Pruned:
    """The ``k`` best items of every user, as ``topn.top_scores`` gives them, ties by id.

    ``exclude (uid, mid)`` holds pairs to leave out before the cut; the bound then holds
    for what is left. Rows without id or vector are left out.
    """
    there = F.col("id").isNotNull() & F.col("features").isNotNull()
    users = user_factors.where(there).select(
        F.col("id").cast("int").alias("id"), "features", norm("features").alias("length")
    )
    items = grouped_items(item_factors, side)
    lengths = items.groupBy("ig").agg(F.max("length").alias("longest")).orderBy("ig")
    bounds = [row["longest"] for row in lengths.collect()]  # one number a group
    n_users = users.count()
    if user_groups is None:
        user_groups = groups_for(n_users, 2 * workers_of(users), USER_SIDE_MAX)

    def blocks_of(group: Column) -> DataFrame:
        longest = F.max("length").over(Window.partitionBy("ig"))
        chosen = items.where(group).withColumn("longest", longest * (1 + 1e-9))
        return item_blocks(chosen, F.col("ig"), F.col("longest"))

    first = users.select(group_of("id", user_groups).alias("tile"), "id", "features", F.lit(None).alias("bound"))
    every = F.explode(F.sequence(F.lit(0), F.lit(user_groups - 1))).alias("tile")
    found = staged(best_in_tiles(
        first, _seen(exclude, first), blocks_of(F.col("ig") == 0).select(every, "*"), k, user_groups,
    ), "first-scores")
    # The k-th best so far; a user who has fewer goes to every group.
    kth = (
        _ranked(found).where(F.col("rank") == k)
        .select(F.col("uid").alias("id"), F.col("score").alias("kth"))
    )
    # The bounds fall from group to group, so a user goes to the first so many. Users who
    # go equally far share a tile, and a block is sent to the tiles that some user takes it to.
    going = staged(
        users.join(kth, "id", "left")
        .withColumn("last", _left_groups(bounds, F.col("length"), F.col("kth"))).where(F.col("last") > 0),
        "users-that-go-on",
    )
    steps = going.agg(F.count("*").alias("n"), F.coalesce(F.sum("last"), F.lit(0)).alias("steps")).first()
    computed = n_users * min(1, len(bounds)) + steps["steps"]
    later_groups = groups_for(steps["n"], 2 * workers_of(users), USER_SIDE_MAX)
    placed = places(going, F.desc("last"), F.col("id")).withColumn(
        "tile", F.floor((F.col("place") - 1) * later_groups / max(1, steps["n"])).cast("int"))
    placed = staged(placed.select("tile", "id", "features", F.col("kth").alias("bound"), "last"), "users-in-tiles")
    reach = placed.groupBy("tile").agg(F.max("last").alias("last"))
    later_blocks = blocks_of(F.col("ig") > 0).join(
        small_side(reach.select("tile", F.explode(F.sequence(F.lit(1), "last")).alias("grp")),
                   later_groups * len(bounds)), "grp")
    later = best_in_tiles(
        placed, _seen(exclude, placed), later_blocks, k, later_groups)
    scores = _ranked(found.union(later)).where(F.col("rank") <= k)
    return Pruned(scores, n_users * len(bounds), computed)


def _left_groups(bounds: list[float], length: Column, kth: Column) -> Column:
    """How many of the groups after the first have a longest vector that lets an item tie
    with ``kth``. Scores are rounded, and so is the bound: it is taken a little higher."""
    if len(bounds) < 2:
        return F.lit(0)
    longest = F.lit([bound * (1 + 1e-9) for bound in bounds[1:]])
    left = F.filter(longest, lambda bound: bound * length + SLACK >= kth)
    return F.when(kth.isNull(), len(bounds) - 1).otherwise(F.size(left))


def _ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "mid")
    return scores.withColumn("rank", F.row_number().over(order))


def pruned_topn(user_factors: DataFrame, item_factors: DataFrame, k: int = 10,
                exclude: DataFrame | None = None, side: int = GROUP) -> DataFrame:
    """The list table ``(uid, recs)``: at most ``k`` items per user, best first."""
    return user_lists(pruned_scores(user_factors, item_factors, k, exclude, side).scores)
