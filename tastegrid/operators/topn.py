"""Best items per user by the inner product of factor vectors, exact."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocks import BAND_ROWS, SLACK, Best, bands, cells, matrix
from ..functions.vectors import dot
from ..schemas import USER_RECS, conform
from .tiles import group_of, groups_for, place_tiles, workers_of

# Users per tile: their vectors are held (131,072 x 64 doubles are 64 MB) while the items
# pass by, so items are copied once for each so many users.
USER_SIDE_MAX = 131_072
# Items of one row; a task holds few such rows at a time.
BLOCK_ITEMS = 1024
# Ids of items of which one row holds those that a user has rated.
SEEN_PART = 65_536

SCORES = "uid int, mid int, score double"
_SCORES_ARROW = pa.schema([("uid", pa.int32()), ("mid", pa.int32()), ("score", pa.float64())])


def factor_scores(pairs: DataFrame, user_factors: DataFrame,
                  item_factors: DataFrame) -> DataFrame:
    """Predicted score of each given pair: the inner product of its two vectors
    ``(uid, mid, prediction)``. Pairs with an unknown user or item drop out."""
    users = user_factors.select(F.col("id").alias("uid"), F.col("features").alias("u"))
    items = item_factors.select(F.col("id").alias("mid"), F.col("features").alias("i"))
    joined = pairs.join(users, "uid").join(items, "mid")
    rest = [c for c in pairs.columns if c not in ("uid", "mid")]
    return joined.select("uid", "mid", *rest, dot("u", "i").alias("prediction"))


# Kinds of rows of a tile, in the order in which a task reads them.
_USER, _SEEN, _ITEMS = 0, 1, 2


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, features, grp, bound)``, by group and id, as rows of up to BLOCK_ITEMS
    vectors of one group. Equal ids stay together."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if len(rest) <= BLOCK_ITEMS:
            continue
        *whole, last = _cuts(rest)
        for start, end in whole:
            yield _block(rest.slice(start, end - start), batch.schema)
        rest = rest.slice(last[0])
    if rest is not None and len(rest):
        for start, end in _cuts(rest):
            yield _block(rest.slice(start, end - start), rest.schema)


def _cuts(table: pa.Table) -> list[tuple[int, int]]:
    ids, grp = table["id"].to_numpy(), table["grp"].to_numpy()
    new_grp = np.flatnonzero(grp[1:] != grp[:-1]) + 1
    new_id = np.union1d(np.flatnonzero(ids[1:] != ids[:-1]) + 1, new_grp)
    out, start = [], 0
    for end in [*new_grp.tolist(), len(ids)]:
        while end - start > BLOCK_ITEMS:
            at = int(np.searchsorted(new_id, start + BLOCK_ITEMS, "right")) - 1
            if at < 0 or new_id[at] <= start:  # more rows of one id than a block's
                at += 1
            cut = int(new_id[at]) if at < len(new_id) else end
            if cut >= end:
                break
            out.append((start, cut))
            start = cut
        out.append((start, end))
        start = end
    return out


def _block(table: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    features = table["features"].combine_chunks()
    matrix(features)  # refuses vectors of different lengths
    flat = features.flatten()
    ids = table["id"].combine_chunks()

    def one(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [table["grp"].combine_chunks()[:1], table["bound"].combine_chunks()[:1], one(ids), one(flat)],
        names=["grp", "bound", "ids", "features"],
    )


def item_blocks(items: DataFrame, grp: Column, bound: Column | None = None) -> DataFrame:
    """``items (id, features)`` as rows ``(grp, bound, ids, features)`` of up to
    BLOCK_ITEMS vectors one behind the other, by ascending id; ``bound`` is the same for
    all vectors of a group."""
    kind = items.schema["features"].dataType.simpleString()
    rows = items.select(
        "id", "features", grp.cast("int").alias("grp"),
        (F.lit(None) if bound is None else bound).cast("double").alias("bound"),
    )
    return rows.repartition("grp", "id").sortWithinPartitions("grp", "id").mapInArrow(
        _packed, f"grp int, bound double, ids array<int>, features {kind}")


class _Tile:
    """Users of a tile, what they have rated, and their best items so far."""

    def __init__(self, k: int):
        self.k, self.users, self.seen, self.best = k, [], [], None

    def ready(self) -> None:
        table = pa.concat_tables(self.users).sort_by("id")
        self.ids = table["id"].to_numpy()
        self.u = matrix(table["features"].combine_chunks())
        self.users = []
        self.length = np.sqrt(np.einsum("ij,ij->i", self.u, self.u))
        # A k-th best score known before: what can't reach it needn't be looked at.
        self.kth = table["bound"].to_numpy().astype(float)
        self.best = Best(len(self.ids), self.k)
        owner, mids = np.empty(0, np.int64), np.empty(0, np.int32)
        if self.seen:
            uids, mids = (np.concatenate(part) for part in zip(*self.seen))
            first, end = (np.searchsorted(self.ids, uids, side) for side in ("left", "right"))
            n = end - first
            owner = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mids = np.repeat(mids, n)
        order = np.argsort(mids, kind="stable")
        self.owner, self.mids = owner[order], mids[order]
        self.seen = []

    def meet(self, item_ids: np.ndarray, v: np.ndarray, bound: float | None) -> None:
        """Offer one block of items to the users whom its ``bound``, the length of its
        longest vector or more, lets gain by it."""
        low = np.searchsorted(self.mids, item_ids[0], "left")
        high = np.searchsorted(self.mids, item_ids[-1], "right")
        mids, owner = self.mids[low:high], self.owner[low:high]
        column = np.minimum(np.searchsorted(item_ids, mids), len(item_ids) - 1)
        present = item_ids[column] == mids
        owner, column = owner[present], column[present]
        going = None
        if bound is not None:
            going = np.flatnonzero(~(bound * self.length + SLACK < self.kth))
            if not len(going):
                return
            at = np.minimum(np.searchsorted(going, owner), len(going) - 1)
            present = going[at] == owner
            owner, column = at[present], column[present]
        order = np.argsort(owner, kind="stable")
        owner, column = owner[order], column[order]
        small, longest = v.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", v, v).max())
        # What single precision may be off, of the product of two lengths.
        off = 2.0 ** -23 * (v.shape[1] + 4)
        for band in bands(len(self.ids) if going is None else len(going), BAND_ROWS):
            rows = np.arange(band.start, band.stop) if going is None else going[band]
            u = self.u[rows]
            a, b = np.searchsorted(owner, [band.start, band.stop])
            r_seen, c_seen = owner[a:b] - band.start, column[a:b]
            least = self.best.scores[rows, -1] - SLACK
            with np.errstate(over="ignore", invalid="ignore"):
                rough = u.astype(np.float32) @ small.T
                floor = least - off * longest * self.length[rows] - 1e-30
                rough[r_seen, c_seen] = -np.inf
                maybe = ~(rough < floor.astype(np.float32)[:, None])
            n = np.count_nonzero(maybe)
            if not n:
                continue
            if n > 4 * len(rows) * self.k or not np.isfinite(floor).all():
                scores = u @ v.T
                scores[r_seen, c_seen] = -np.inf
                maybe = (scores >= least[:, None]) & (scores > -np.inf)
                if np.count_nonzero(maybe) > 4 * len(rows) * self.k and v.shape[0] > self.k:
                    maybe &= Best.among_best(scores, self.k)
                r, c = cells(maybe)
                score = scores[r, c]
            else:
                maybe[r_seen, c_seen] = False
                r, c = cells(maybe)
                score = np.einsum("ij,ij->i", u[r], v[c])
            if len(r):
                self.best.offer_cells(rows[r], score, item_ids[c])

    def rows(self) -> pa.RecordBatch:
        if self.best is None:
            return _scores_batch([], [], [])
        return _scores_batch(*self.best.rows(self.ids))


def _scores_batch(uid, mid, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(uid, pa.int32()), pa.array(mid, pa.int32()), pa.array(score, pa.float64())],
        schema=_SCORES_ARROW,
    )


def best_for_users(k: int):
    """Rows of tiles, by tile and kind, as the ``k`` best of each user of a tile. The users
    of one tile are held, and one block of items at a time."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tile = None, None
        for batch in batches:
            tiles, kinds = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)]):
                if start == end:
                    continue
                if tiles[start] != number:
                    if tile is not None:
                        yield tile.rows()
                    number, tile = tiles[start], _Tile(k)
                part = batch.slice(start, end - start)
                if kinds[start] == _USER:
                    tile.users.append(pa.Table.from_batches([part.select(["id", "features", "bound"])]))
                elif kinds[start] == _SEEN:
                    ids = part.column("ids")
                    uid = part.column("id").to_numpy()[pc.list_parent_indices(ids).to_numpy()]
                    tile.seen.append((uid, ids.flatten().to_numpy()))
                elif tile.users or tile.best is not None:
                    if tile.best is None:
                        tile.ready()
                    for i in range(len(part)):
                        ids = part.column("ids")[i].values.to_numpy()
                        flat = part.column("features")[i].values.to_numpy(zero_copy_only=False)
                        v = flat.astype(np.float64).reshape(len(ids), -1)
                        if v.shape[1] != tile.u.shape[1]:
                            raise ValueError(f"vectors of different lengths: {tile.u.shape[1]}, {v.shape[1]}")
                        tile.meet(ids, v, part.column("bound")[i].as_py())
        if tile is not None:
            yield tile.rows()
    return kernel


def best_in_tiles(users: DataFrame, seen: DataFrame | None, blocks: DataFrame, k: int,
                  tiles: int) -> DataFrame:
    """The best ``k`` of each tile ``(uid, mid, score)``, from ``users (tile, id, features,
    bound)``, ``seen (tile, id, ids)`` and ``blocks (tile, bound, ids, features)``.

    The blocks of a tile pass its task one by one; only its users are held."""
    kind = blocks.schema["features"].dataType
    no_ids = F.lit(None).cast("array<int>").alias("ids")
    none = F.lit(None)
    rows = users.select(
        "tile", F.lit(_USER).alias("kind"), "id", F.col("features").cast(kind).alias("features"),
        F.col("bound").cast("double").alias("bound"), no_ids,
    ).unionByName(blocks.select(
        "tile", F.lit(_ITEMS).alias("kind"), none.cast("int").alias("id"), "features", "bound", "ids"
    ))
    if seen is not None:
        rows = rows.unionByName(seen.select(
            "tile", F.lit(_SEEN).alias("kind"), "id", none.cast(kind).alias("features"),
            none.cast("double").alias("bound"), "ids",
        ))
    return place_tiles(rows, tiles).sortWithinPartitions("tile", "kind").mapInArrow(
        best_for_users(k), SCORES)


def seen_of_users(exclude: DataFrame) -> DataFrame:
    """``exclude (uid, mid)``, deduplicated, as rows ``(id, ids)`` with at most the ids of
    one part of all items: no row holds all that a user has rated of very many."""
    return (
        exclude.where(F.col("uid").isNotNull() & F.col("mid").isNotNull())
        .select(F.col("uid").cast("int").alias("id"), F.col("mid").cast("int").alias("mid"))
        .groupBy("id", F.floor(F.col("mid") / SEEN_PART).alias("part"))
        .agg(F.collect_set("mid").alias("ids")).select("id", "ids")
    )


def with_vector(factors: DataFrame) -> DataFrame:
    there = F.col("id").isNotNull() & F.col("features").isNotNull()
    return factors.select(F.col("id").cast("int").alias("id"), "features").where(there)


def top_scores(user_factors: DataFrame, item_factors: DataFrame, k: int = 10,
               exclude: DataFrame | None = None, user_groups: int | None = None,
               item_groups: int | None = None) -> DataFrame:
    """The ``k`` best items of every user ``(uid, mid, score, rank)``; ties by item id.

    Users are dealt to tiles, and the items pass each of them in blocks: an item is copied
    once for each USER_SIDE_MAX users, a user's list is cut where it is made.
    ``exclude (uid, mid)`` holds pairs to leave out before the cut. They travel to the
    user's tile, deduplicated. Rows without id or vector are left out.
    """
    users, items = with_vector(user_factors), with_vector(item_factors)
    wanted = 2 * workers_of(users)
    if user_groups is None:
        user_groups = groups_for(users.count(), wanted, USER_SIDE_MAX)
    if item_groups is None:
        # Few users alone keep no more tasks busy than they have groups.
        item_groups = min(groups_for(items.count(), -(-wanted // user_groups)), -(-wanted // user_groups))

    all_items = F.explode(F.sequence(F.lit(0), F.lit(item_groups - 1)))
    all_users = F.explode(F.sequence(F.lit(0), F.lit(user_groups - 1)))
    tile = (F.col("ug") * item_groups + F.col("ig")).alias("tile")

    def at_users(rows: DataFrame) -> DataFrame:
        placed = rows.select("*", group_of("id", user_groups).alias("ug"), all_items.alias("ig"))
        return placed.select(tile, *rows.columns)
    blocks = item_blocks(items, group_of("id", item_groups))
    found = best_in_tiles(
        at_users(users.withColumn("bound", F.lit(None))),
        None if exclude is None else at_users(
            seen_of_users(exclude).join(users.select("id"), "id", "left_semi")),
        blocks.select("*", F.col("grp").alias("ig"), all_users.alias("ug")).select(tile, *blocks.columns),
        k, user_groups * item_groups,
    )
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "mid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topn_from_factors(user_factors: DataFrame, item_factors: DataFrame, k: int = 10,
                      exclude: DataFrame | None = None, user_groups: int | None = None,
                      item_groups: int | None = None) -> DataFrame:
    """The list table ``(uid, recs)``: at most ``k`` items per user, best first."""
    return user_lists(top_scores(user_factors, item_factors, k, exclude, user_groups, item_groups))


def user_lists(best: DataFrame) -> DataFrame:
    """``best (uid, mid, score, rank)`` as the list table ``(uid, recs)``."""
    entry = F.struct("rank", "mid", "score")
    lists = best.groupBy("uid").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    recs = F.transform(
        "entries", lambda e: F.struct(e["mid"].alias("mid"), e["score"].alias("score"))
    )
    return conform(lists.select("uid", recs.alias("recs")), USER_RECS)
