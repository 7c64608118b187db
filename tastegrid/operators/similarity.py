"""Item-item cosine neighbours, exact.

The pairs are those of a product of the factor matrix with itself. Each tile of
that product is one Spark task group; the threshold, and the cut to the best k
when one is asked for, are applied inside the tile, before any row leaves it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import (
    BAND_COLS, BAND_ROWS, DECIMALS, Best, bands, cells, matrix, unit_rows,
)
from ..schemas import MOVIE_RECS, conform
from .tiles import SIDE_MAX, group_of, groups_for, groups_for_square, place_tiles, usable, workers_of
from .topn import item_blocks

# Fixed value: the cosine a neighbour has to exceed.
THRESHOLD = 0.7
# Longest list held in one row of a neighbour table.
SEGMENT = 50_000

# Entries that a task holds before it hands them on.
RUN_ENTRIES = 1 << 20
# Items whose lists one task makes at most (131,072 x 64 doubles are 64 MB), and groups of
# SIDE_MAX of them before they grow to that.
LEFT_MAX, GROUPS = 131_072, 48
# Vectors that meet a block of others at once, and cosines worked out at once.
LEFT_ROWS, EXACT_ROWS = 2048, 1 << 16
# Pairs with both of their vectors in a batch.
JOINED_ROWS = 16_384

PAIRS = "mid int, other int, score double"
JOINED = PAIRS + ", back double, a array<float>, b array<float>"
RUNS = "mid int, entries array<bigint>"
LISTS = "mid int, start int, recs array<struct<mid: int, score: double>>"
PAIRS_ARROW = pa.schema([("mid", pa.int32()), ("other", pa.int32()), ("score", pa.float64())])


def pairs_batch(mid, other, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(mid, pa.int32()), pa.array(other, pa.int32()), pa.array(score, pa.float64())],
        schema=PAIRS_ARROW,
    )


def side_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order, with their unit vectors."""
    table = table.sort_by("id")
    vectors = table["features"].combine_chunks()
    return table["id"].to_numpy(), unit_rows(matrix(vectors))


# Where a row stands in its tile. In a tile of a group with itself it is on both sides.
_LEFT, _RIGHT, _BOTH = 0, 1, 2


def _read_tile(batches):
    table = pa.Table.from_batches(list(batches))
    side = table["side"].to_numpy()
    same = side[0] == _BOTH
    if same:
        left = right = side_of(table)
    else:
        left, right = (side_of(table.filter(pa.array(side == s))) for s in (_LEFT, _RIGHT))
    return same, left, right


def _hits(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple]:
    """(ids, other ids, cosines as they are) above the threshold, band by band, each pair once."""
    same, (a_ids, a), (b_ids, b) = _read_tile(batches)
    if not len(a_ids) or not len(b_ids):
        return
    for rows in bands(len(a_ids), BAND_ROWS):
        for cols in bands(len(b_ids), BAND_COLS):
            if same and cols.stop <= rows.start:
                continue
            scores = a[rows] @ b[cols].T
            hit = scores > threshold
            if same:
                hit &= a_ids[rows][:, None] < b_ids[cols][None, :]
            r, c = cells(hit)
            if len(r):
                yield a_ids[rows][r], b_ids[cols][c], scores[r, c]


def _pairs_in_tile(threshold: float):
    def kernel(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        for x, y, score in _hits(batches, threshold):
            score = np.round(score, DECIMALS)
            yield pairs_batch(x, y, score)
            yield pairs_batch(y, x, score)
    return kernel


def _turned(rows: pa.Table) -> pa.Table:
    """Rows ``(mid, other, score)`` as ``(other, mid, back)``."""
    return pa.table({"mid": rows["other"], "other": rows["mid"], "back": rows["score"]})


def _same_pairs(one: pa.Table, turned: pa.Table) -> bool:
    return len(one) == len(turned) and one["mid"].equals(turned["mid"]) and one["other"].equals(turned["other"])


def _matched(rows: pa.Table) -> pa.Table:
    found = rows.join(_turned(rows), ["mid", "other"], join_type="left outer")
    return found.select(["mid", "other", "score", "back"])


def _with_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Pairs with the score of the same pair the other way as ``back``, null where none comes.

    Pairs are held until the other way comes, which is the next batch in a tile's own order."""
    held = pa.table({"mid": [], "other": [], "score": []}, PAIRS_ARROW)
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(held):
            held = rows
        elif _same_pairs(held, _turned(rows)):
            yield held.append_column("back", rows["score"])
            yield rows.append_column("back", held["score"])
            held = held.slice(0, 0)
        else:
            found = _matched(pa.concat_tables([held, rows]))
            alone = found["back"].is_null()
            yield found.filter(pc.invert(alone))
            held = found.filter(alone).drop_columns("back")
    yield _matched(held)


def _vectors_of(ids: pa.ChunkedArray, vectors: pa.Table) -> pa.Array:
    """The vectors ``(id, features)``, ids ascending, of ``ids``; null where there is none."""
    own, ids = vectors["id"].to_numpy(), ids.to_numpy()
    at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
    return vectors["features"].combine_chunks().take(pa.array(at, mask=own[at] != ids))


def _joined_in_tile(threshold: float):
    """As ``_pairs_in_tile``, with ``back`` and both vectors, which the tile has."""
    pairs = _pairs_in_tile(threshold)

    def kernel(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        vectors = pa.Table.from_batches(batches).select(["id", "features"]).sort_by("id")
        for rows in _with_back(pairs(key, iter(batches))):
            for part in bands(len(rows), JOINED_ROWS):
                some = rows.slice(part.start, JOINED_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [*(some[c].combine_chunks() for c in ("mid", "other", "score", "back")),
                     _vectors_of(some["mid"], vectors), _vectors_of(some["other"], vectors)],
                    names=["mid", "other", "score", "back", "a", "b"])
    return kernel


def _entries(other: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Entries as whole numbers that sort like a list: by score, best first, then by id. The
    score is one in steps of its last decimal, the number that rounding itself goes by."""
    steps = np.rint(score * 10.0 ** DECIMALS).astype(np.int64)
    return (-steps << 32) + (other.astype(np.int64) + 2 ** 31)


def _of_entries(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = (entries & 0xFFFFFFFF) - 2 ** 31
    return other.astype(np.int32), -(entries >> 32) / 10.0 ** DECIMALS


def _above(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray,
           threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, other ids, cosines) above the threshold of unit vectors with a block of others.

    Single precision finds what may be above it; the cosine itself is the sum of the same
    products in the same order whichever of the two is on the left."""
    small = b.astype(np.float32).T
    # What single precision may be off, of vectors of length one.
    floor = np.float32(threshold - 2.0 ** -23 * (b.shape[1] + 4))
    for rows in bands(len(a_ids), LEFT_ROWS):
        r, c = cells(a[rows].astype(np.float32) @ small >= floor)
        for part in bands(len(r), EXACT_ROWS):
            x, y = rows.start + r[part], c[part]
            score = np.einsum("ij,ij->i", a[x], b[y])
            hit = (score > threshold) & (a_ids[x] != b_ids[y])
            if hit.any():
                yield a_ids[x[hit]], b_ids[y[hit]], score[hit]


def _runs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Items with their entries, as a row for each item."""
    mid, entries = (np.concatenate(part) for part in zip(*held))
    order = np.argsort(mid, kind="stable")
    mid, entries = mid[order], entries[order]
    starts = np.flatnonzero(np.r_[True, mid[1:] != mid[:-1]])
    runs = pa.ListArray.from_arrays(
        pa.array(np.r_[starts, len(mid)], pa.int32()), pa.array(entries, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(mid[starts], pa.int32()), runs], names=["mid", "entries"])


def runs_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(mid, other, score)`` as runs ``(mid, entries)``, one for each item of a batch."""
    for batch in batches:
        if len(batch):
            mid, other, score = (batch.column(name).to_numpy() for name in ("mid", "other", "score"))
            yield _runs([(mid, _entries(other, score))])


def lists_of_runs(runs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The neighbour table of runs that lie anywhere: they are shuffled, eight bytes an entry,
    and those of one item are sorted in one task."""
    lists = runs.repartition("mid").sortWithinPartitions("mid").mapInArrow(_merged(segment), LISTS)
    return conform(lists, MOVIE_RECS)


def _runs_of_groups(threshold: float):
    """Rows of tiles, by tile and side, as runs of entries ``(mid, entries)`` of the items on
    the left. These are held, and one block of the right; at most RUN_ENTRIES entries and
    those of one band wait to be handed on."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, left, held, n = None, [], None, [], 0
        for batch in batches:
            tiles, sides = batch.column("tile").to_pylist(), batch.column("side").to_pylist()
            for i, side in enumerate(sides):
                if tiles[i] != tile:
                    tile, parts, left = tiles[i], [], None
                ids = batch.column("ids")[i].values.to_numpy()
                flat = batch.column("features")[i].values.to_numpy(zero_copy_only=False)
                block = ids, unit_rows(flat.astype(np.float64).reshape(len(ids), -1))
                if side == _LEFT:
                    parts.append(block)
                    continue
                if left is None:
                    left, parts = [np.concatenate(part) for part in zip(*parts)], []
                for x, y, score in _above(*left, *block, threshold):
                    held.append((x, _entries(y, score)))
                    n += len(x)
                    if n >= RUN_ENTRIES:
                        yield _runs(held)
                        held, n = [], 0
        if held:
            yield _runs(held)
    return kernel


def _merged(segment: int):
    """Rows ``(mid, entries)`` in order of the item as rows of the neighbour table."""
    def rows(done: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        lists = [(mid, at, entries[at:at + segment])
                 for mid, entries in done for at in range(0, len(entries), segment)]
        other, score = _of_entries(np.concatenate([part for *_, part in lists]))
        recs = pa.StructArray.from_arrays([pa.array(other), pa.array(score)], ["mid", "score"])
        offsets = np.cumsum([0, *(len(part) for *_, part in lists)])
        return pa.RecordBatch.from_arrays(
            [pa.array([mid for mid, *_ in lists], pa.int32()),
             pa.array([at for _, at, _ in lists], pa.int32()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), recs)],
            names=["mid", "start", "recs"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, done, n = None, [], [], 0
        for batch in batches:
            mids, runs = batch.column("mid").to_numpy(), batch.column("entries")
            for i, mid in enumerate(mids.tolist()):
                if mid != own and held:
                    done.append((own, np.sort(np.concatenate(held))))
                    n += len(done[-1][1])
                    held = []
                    if n >= RUN_ENTRIES:
                        yield rows(done)
                        done, n = [], 0
                own = mid
                held.append(runs[i].values.to_numpy())
        if held:
            done.append((own, np.sort(np.concatenate(held))))
        if done:
            yield rows(done)
    return kernel


def _best_in_tile(threshold: float, k: int):
    def kernel(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        same, (a_ids, a), (b_ids, b) = _read_tile(batches)
        if not len(a_ids) or not len(b_ids):
            return
        best_a = Best(len(a_ids), k)
        best_b = None if same else Best(len(b_ids), k)
        for rows in bands(len(a_ids), BAND_ROWS):
            for cols in bands(len(b_ids), BAND_COLS):
                scores = a[rows] @ b[cols].T
                if same:
                    scores[a_ids[rows][:, None] == b_ids[cols][None, :]] = -np.inf
                scores[scores <= threshold] = -np.inf
                best_a.offer(rows, scores, b_ids[cols])
                if best_b is not None:
                    best_b.offer(cols, scores.T, a_ids[rows])
        yield pairs_batch(*best_a.rows(a_ids))
        if best_b is not None:
            yield pairs_batch(*best_b.rows(b_ids))
    return kernel


def _tiles(factors: DataFrame, groups: int | None) -> DataFrame:
    """The tiles ``(tile, side, id, features)`` of all pairs of groups."""
    vectors = usable(factors)
    if groups is None:
        groups = groups_for_square(factors.count(), workers_of(factors))
    # Tile of groups i <= j, numbered along the upper triangle.
    own = F.col("grp")
    low, high = (lambda h: F.least(own, h)), (lambda h: F.greatest(own, h))
    places = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda h: F.struct(
            (low(h) * groups - F.shiftright(low(h) * (low(h) - 1), 1) + high(h) - low(h))
            .alias("tile"),
            F.when(h == own, _BOTH).when(own < h, _LEFT).otherwise(_RIGHT).alias("side"),
        ),
    )
    return place_tiles(
        vectors.withColumn("grp", group_of("id", groups))
        .withColumn("at", F.explode(places))
        .select("at.tile", "at.side", "id", "features"),
        groups * (groups + 1) // 2,
    )


def _groups_of_lists(n: int, workers: int) -> int:
    """Groups of items whose lists are made by one task each, all items passing by: up to
    GROUPS groups are small, so that their entries are sorted in memory. More vectors make
    larger groups, since each group costs a copy of all vectors."""
    return groups_for(n, max(2 * workers, min(-(-n // SIDE_MAX), GROUPS)), LEFT_MAX)


def _groups_and_blocks(factors: DataFrame, groups: int | None, parts: int) -> DataFrame:
    """Rows ``(tile, side, ids, features)``: a group's own vectors, then those of all items.
    Each of ``parts`` of the ids has groups of its own, since both go by the same hash."""
    vectors = usable(factors)
    if groups is None:
        groups = _groups_of_lists(factors.count(), workers_of(factors))
    groups = -(-groups // parts) * parts
    blocks = item_blocks(vectors, group_of("id", groups))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    rows = blocks.select(F.col("grp").alias("tile"), F.lit(_LEFT).alias("side"), "ids", "features").union(
        blocks.select(everywhere.alias("tile"), F.lit(_RIGHT).alias("side"), "ids", "features"))
    return place_tiles(rows, groups)


def similar_pairs(factors: DataFrame, threshold: float = THRESHOLD,
                  k: int | None = None, groups: int | None = None,
                  joined: bool = False) -> DataFrame:
    """Ordered pairs ``(mid, other, score)`` with cosine strictly above ``threshold``.

    The cosine is tested as it is, with and without ``k``, and rounded when emitted.

    With ``k``, only the k best partners of each item (by score, then id) are kept;
    each tile then emits at most k rows per item and side.

    ``joined`` adds to all pairs the score ``back`` of the pair the other way, null without
    one, and the vectors ``a`` and ``b``. A tile has them all, so no pair is shuffled.
    """
    if joined and k is not None:
        raise ValueError("only all pairs are joined, not the best k of each item")
    if groups is None:
        groups = groups_for_square(factors.count(), workers_of(factors))
    placed = _tiles(factors, groups)
    if joined:
        return placed.groupBy("tile").applyInArrow(_joined_in_tile(threshold), JOINED)
    kernel = _pairs_in_tile(threshold) if k is None else _best_in_tile(threshold, k)
    found = placed.groupBy("tile").applyInArrow(kernel, PAIRS)
    if k is None or groups == 1:
        return found
    return ranked(found).where(F.col("rank") <= k).drop("rank")


def ranked(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the rank of each partner in its item's list, from 1."""
    order = Window.partitionBy("mid").orderBy(F.desc("score"), "other")
    return pairs.withColumn("rank", F.row_number().over(order))


def similar_items(factors: DataFrame, threshold: float = THRESHOLD,
                  k: int | None = None, segment: int = SEGMENT,
                  groups: int | None = None, parts: int = 1) -> DataFrame:
    """The neighbour table ``(mid, start, recs)``, lists best first.

    A list longer than ``segment`` continues in further rows, ``start`` being the
    number of entries before the row, so that an item similar to very many others
    never has to fit one array. Each task makes the whole lists of a group of items, which all
    items pass in blocks, so that no entry is shuffled; its runs of packed entries, eight
    bytes each, are sorted by item where they are made. A task's lists come in order of the
    item, and are of one of the ``parts`` that a layout has.
    """
    if k is not None:
        return neighbour_lists(ranked(similar_pairs(factors, threshold, k, groups)), segment)
    placed = _groups_and_blocks(factors, groups, parts)
    runs = placed.sortWithinPartitions("tile", "side").mapInArrow(_runs_of_groups(threshold), RUNS)
    # An item's runs are of one task, so they meet where they are made.
    lists = runs.sortWithinPartitions("mid").mapInArrow(_merged(segment), LISTS)
    return conform(lists, MOVIE_RECS)


def neighbour_lists(pairs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The pairs ``(mid, other, score, rank)`` as rows of the neighbour table."""
    entry = F.struct("rank", F.col("other").alias("mid"), "score")
    place = F.col("rank") - 1
    lists = (
        pairs.withColumn("start", place - place % segment)
        .groupBy("mid", "start")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    recs = F.transform(
        "entries", lambda e: F.struct(e["mid"].alias("mid"), e["score"].alias("score"))
    )
    return conform(lists.select("mid", "start", recs.alias("recs")), MOVIE_RECS)


def heads(movie_recs: DataFrame, k: int) -> DataFrame:
    """The rows of the table that hold the first ``k`` entries of a list, cut to these."""
    head = F.slice("recs", F.lit(1), F.lit(k) - F.col("start"))
    return movie_recs.where(F.col("start") < k).withColumn("recs", head)


def top_similar(movie_recs: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` neighbours of each item ``(mid, recs)``, read off the table.

    As many rows of a list are read as ``k`` needs, whatever the table's segments."""
    # Grouped by the item as one value: a join by item then shuffles both of its sides
    # itself, which lets Spark split an item that is asked for very often.
    # What is beyond the first ``k`` is cut before the shuffle.
    parts = (
        heads(movie_recs, k).select("mid", "start", "recs")
        .groupBy(F.struct("mid").alias("item"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "recs"))).alias("parts"))
        .select("item.mid", "parts")
    )
    whole = F.flatten(F.transform("parts", lambda part: part["recs"]))
    return parts.select("mid", F.slice(whole, 1, k).alias("recs"))
