"""Nearest vectors by inner product: a hierarchical small-world graph for each shard.

Vectors are dealt to shards of bounded size. In a shard they stand in random order, and
layer l of its graph holds the first so many of them, fewer the higher the layer; every
layer is one flat array of neighbours. A query goes down the layers of each shard, and the
best of all shards are merged. Scores are inner products of the vectors themselves, in
double precision; the graph only says which vectors to score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.tiles import PARTITIONS_MAX, SIDE_MIN, workers_of
from .embeddings import usable
from .stages import staged

NEAREST = 20
# Numbers of a shard's vectors at most: a task holds them in two precisions, with links.
SHARD_NUMBERS = 2 << 20
# Vectors of a layer to one of the layer above, and of the top layer at most, which is
# compared whole.
STEP, TOP = 16, 64
# Links of a vector when it is put in, links it is cut to, and room for those that others
# add before it is cut; twice as many on the lowest layer.
LINKS, KEPT, ROOM = 24, 24, 36
# Vectors held while one is put in, while a query passes a layer, and on the lowest layer.
PUT_IN, PASSING, HELD = 64, 8, 192
# Vectors put in, or queries answered, together; vectors taken up from the beam at a time.
TOGETHER, AT_ONCE = 256, 4
# Vectors of a stored block, and queries of one.
BLOCK, QUERIES = 4096, 512


# --- the graph of one shard

def layer_sizes(n: int) -> list[int]:
    """Vectors of each layer, the lowest first."""
    sizes = [n]
    while sizes[-1] > TOP:
        sizes.append(-(-sizes[-1] // STEP))
    return sizes


def on_a_sphere(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` shrunk to length 1 at most, with a component more that makes them all as
    long: the nearest on that sphere are those of the largest inner product."""
    largest = np.abs(vectors).max(initial=np.finfo(float).tiny)
    scaled = vectors / largest
    lengths = (scaled * scaled).sum(axis=1)
    longest = lengths.max(initial=np.finfo(float).tiny)
    rest = np.sqrt(np.maximum(0, 1 - lengths / longest))
    return np.column_stack([scaled / np.sqrt(longest), rest]).astype(np.float32)


@dataclass
class Graph:
    """``points`` on the sphere, and ``layers[l][i]``: the neighbours of point i on layer l,
    -1 where there are fewer. The top layer has none, it is compared whole."""

    points: np.ndarray
    layers: list[np.ndarray]
    sizes: list[int]

    def entries(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        scores = queries @ self.points[:self.sizes[-1]].T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        return order, np.take_along_axis(scores, order, axis=1)

    def beam(self, layer: int, queries: np.ndarray, at: np.ndarray, scores: np.ndarray,
             held: int) -> tuple[np.ndarray, np.ndarray]:
        """From the points ``at`` along the links of ``layer``: the best ``held`` points met
        by each query, best first, until the neighbours of all of them have been seen."""
        links, n = self.layers[layer], self.sizes[layer]
        seen = np.zeros((len(queries), n), bool)
        rows = np.arange(len(queries))
        ids = np.full((len(queries), held), -1, np.int32)
        best = np.full((len(queries), held), -np.inf, np.float32)
        width = min(held, at.shape[1])
        ids[:, :width], best[:, :width] = at[:, :width], scores[:, :width]
        open_ = ids >= 0
        where = np.nonzero(open_)
        seen[where[0], ids[where]] = True
        live = rows[open_.any(axis=1)]
        while len(live):
            turn = np.argsort(~open_[live], axis=1, kind="stable")[:, :AT_ONCE]
            taken = open_[live[:, None], turn]
            open_[live[:, None], turn] = False
            row, point = [], []
            for t in range(turn.shape[1]):
                some = live[taken[:, t]]
                near = np.take(links, ids[some, turn[taken[:, t], t]], axis=0)
                r, c = np.nonzero((near >= 0) & ~seen[some[:, None], near])
                row.append(some[r])
                point.append(near[r, c])
                seen[row[-1], point[-1]] = True
            row, point = np.concatenate(row), np.concatenate(point)
            found = np.einsum(
                "ij,ij->i", np.take(self.points, point, axis=0), np.take(queries, row, axis=0))
            better = np.flatnonzero(found > best[row, -1])
            better = better[np.argsort(row[better], kind="stable")]
            row, point, found = row[better], point[better], found[better]
            live = np.unique(row)
            line = np.searchsorted(live, row)
            column = held + np.arange(len(row)) - np.searchsorted(row, row)
            width = int(column.max(initial=held - 1)) + 1
            all_ids = np.full((len(live), width), -1, np.int32)
            all_best = np.full((len(live), width), -np.inf, np.float32)
            all_open = np.zeros((len(live), width), bool)
            all_ids[:, :held], all_best[:, :held], all_open[:, :held] = ids[live], best[live], open_[live]
            all_ids[line, column], all_best[line, column], all_open[line, column] = point, found, True
            order = np.argsort(-all_best, axis=1)[:, :held]
            ids[live] = np.take_along_axis(all_ids, order, axis=1)
            best[live] = np.take_along_axis(all_best, order, axis=1)
            open_[live] = np.take_along_axis(all_open, order, axis=1)
            live = rows[open_.any(axis=1)]
        return ids, best

    def search(self, queries: np.ndarray, held: int = HELD) -> np.ndarray:
        """The best points found for each query, best first, -1 where there are fewer."""
        if len(self.sizes) == 1:
            return self.entries(queries, held)[0]
        at, scores = self.entries(queries, PASSING)
        for layer in range(len(self.sizes) - 2, 0, -1):
            at, scores = self.beam(layer, queries, at, scores, PASSING)
        return self.beam(0, queries, at, scores, held)[0]


def spread(points: np.ndarray, cand: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """``most`` of the candidates of each row, which are in order of their scores: those
    that no candidate taken before is nearer to than the row's own point; then, where there
    is room, the best of the others. -1 stands for none."""
    near = points[cand]
    between = near @ near.transpose(0, 2, 1)
    shut = cand < 0
    taken = np.zeros(cand.shape, bool)
    count = np.zeros(len(cand), int)
    for j in range(cand.shape[1]):
        ok = ~shut[:, j] & (count < most)
        taken[:, j] = ok
        count += ok
        shut |= ok[:, None] & (between[:, j] > scores)
    rank = np.where(taken, 0, np.where(cand >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(cand, order, axis=1)


class Builder:
    def __init__(self, points: np.ndarray):
        self.sizes = layer_sizes(len(points))
        layers = [
            np.full((n, ROOM * (2 if l == 0 else 1)), -1, np.int32)
            for l, n in enumerate(self.sizes[:-1])
        ]
        self.graph = Graph(points, layers, self.sizes)
        self.degrees = [np.zeros(len(links), np.int32) for links in layers]

    def build(self) -> Graph:
        top = self.sizes[-1]
        if len(self.sizes) > 1:
            self._put_in(0, top, len(self.sizes) - 2)
        done = top
        for layer in range(len(self.sizes) - 2, -1, -1):
            while done < self.sizes[layer]:
                end = min(done + TOGETHER, self.sizes[layer])
                self._put_in(done, end, layer)
                done = end
        return self.graph

    def _put_in(self, start: int, end: int, highest: int) -> None:
        """Link the points from ``start`` to ``end`` with those before and with each other,
        on the layers up to ``highest``."""
        points = self.graph.points
        queries = points[start:end]
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        mates = np.broadcast_to(np.arange(start, end), among.shape)
        at, scores = self.graph.entries(queries, PASSING) if start else (mates[:, :0], among[:, :0])
        for layer in range(len(self.sizes) - 2, highest, -1):
            at, scores = self.graph.beam(layer, queries, at, scores, PASSING)
        for layer in range(highest, -1, -1):
            if start:
                at, scores = self.graph.beam(layer, queries, at, scores, PUT_IN)
            ids = np.concatenate([at, mates], axis=1)
            both = np.concatenate([scores, among], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :PUT_IN]
            both = np.take_along_axis(both, order, axis=1)
            ids = np.where(np.isfinite(both), np.take_along_axis(ids, order, axis=1), -1)
            chosen = spread(points, ids, both, LINKS)
            width = chosen.shape[1]
            self.graph.layers[layer][start:end, :width] = chosen
            self.degrees[layer][start:end] = (chosen >= 0).sum(axis=1)
            row, column = np.nonzero(chosen >= 0)
            self._link_back(layer, chosen[row, column], start + row)

    def _link_back(self, layer: int, to: np.ndarray, new: np.ndarray) -> None:
        """Add each ``new`` point to the links of the point ``to`` it has chosen. Where the
        room is used up, the links are cut first."""
        links, degrees = self.graph.layers[layer], self.degrees[layer]
        room = links.shape[1]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        # Mates that have chosen each other are linked already.
        known = (links[to] == new[:, None]).any(axis=1)
        to, new = to[~known], new[~known]
        while len(to):
            owners, first, count = np.unique(to, return_index=True, return_counts=True)
            full = owners[degrees[owners] + count > room]
            self._cut(layer, full)
            slot = degrees[to] + np.arange(len(to)) - np.repeat(first, count)
            fits = slot < room
            links[to[fits], slot[fits]] = new[fits]
            np.add.at(degrees, to[fits], 1)
            to, new = to[~fits], new[~fits]

    def _cut(self, layer: int, owners: np.ndarray) -> None:
        links, points = self.graph.layers[layer], self.graph.points
        most = KEPT * (2 if layer == 0 else 1)
        for start in range(0, len(owners), TOGETHER):
            own = owners[start:start + TOGETHER]
            cand = links[own]
            scores = np.einsum("ijk,ik->ij", points[cand], points[own])
            scores[cand < 0] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")
            cand = np.take_along_axis(cand, order, axis=1)
            chosen = spread(points, cand, np.take_along_axis(scores, order, axis=1), most)
            links[own] = -1
            links[own, :most] = chosen
            self.degrees[layer][own] = (chosen >= 0).sum(axis=1)


def build_graph(vectors: np.ndarray) -> Graph:
    return Builder(on_a_sphere(vectors)).build()


# --- shards

INDEX = (
    "tile int, layer int, first int, size int, width int, ids array<long>, keys array<long>, "
    "numbers array<double>, links array<int>"
)
# Layers that stand for a shard's vectors and, after everything else, for queries.
VECTORS, ASKED = -1, 1 << 30


def index_shards(dealt: DataFrame) -> DataFrame:
    """The index of ``dealt (tile, vec_id, key, vector)``, rows INDEX: of each tile, which is
    a shard, its vectors and the neighbours of every layer, in blocks of flat arrays."""

    def build(batches):
        for tile, rows in _groups(batches):
            order = np.random.default_rng(len(rows[0])).permutation(len(rows[0]))
            order = np.lexsort((rows[1], rows[0]))[order]
            ids, keys, vectors = rows[0][order], rows[1][order], rows[2][order]
            graph = build_graph(vectors)
            for at in range(0, len(ids), BLOCK):
                part = slice(at, at + BLOCK)
                yield _index_row(tile, VECTORS, at, len(ids), vectors.shape[1], ids[part],
                                 keys[part], vectors[part].reshape(-1), None)
            for layer, links in enumerate(graph.layers):
                for at in range(0, len(links), BLOCK):
                    yield _index_row(tile, layer, at, len(links), links.shape[1], None, None,
                                     None, links[at:at + BLOCK].reshape(-1))

    return dealt.select("tile", "vec_id", "key", "vector").mapInArrow(build, INDEX)


def _index_row(tile, layer, first, size, width, ids, keys, numbers, links) -> pa.RecordBatch:
    def one(values, kind):
        return pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays([
        *(pa.array([x], pa.int32()) for x in (tile, layer, first, size, width)),
        one(ids, pa.int64()), one(keys, pa.int64()), one(numbers, pa.float64()), one(links, pa.int32()),
    ], names=[field.split()[0] for field in INDEX.split(", ")])


def _groups(batches) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The rows of one tile after the other; rows come in order of the tile."""
    held, tile = [], None
    for batch in batches:
        if not len(batch):
            continue
        tiles = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1), len(tiles)]
        for start, end in zip(cuts, cuts[1:]):
            if held and tiles[start] != tile:
                yield tile, _joined(held)
                held = []
            tile = int(tiles[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield tile, _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.concatenate([p.column(1).to_numpy() for p in parts])
    keys = np.concatenate([p.column(2).to_numpy() for p in parts])
    flat = np.concatenate([p.column(3).flatten().to_numpy(zero_copy_only=False) for p in parts])
    return ids, keys, flat.astype(np.float64).reshape(len(ids), -1)


@dataclass
class Shard:
    """A shard's index as it is read block by block."""

    ids: np.ndarray
    keys: np.ndarray
    vectors: np.ndarray
    layers: list[np.ndarray]
    graph: Graph | None = None

    @staticmethod
    def of(row) -> "Shard":
        size, width = row["size"].as_py(), row["width"].as_py()
        return Shard(np.empty(size, np.int64), np.empty(size, np.int64), np.empty((size, width)), [])

    def add(self, row) -> None:
        layer, first = row["layer"].as_py(), row["first"].as_py()
        if layer == VECTORS:
            ids = row["ids"].values.to_numpy()
            part = slice(first, first + len(ids))
            self.ids[part], self.keys[part] = ids, row["keys"].values.to_numpy()
            self.vectors[part] = row["numbers"].values.to_numpy().reshape(len(ids), -1)
            return
        if layer == len(self.layers):
            self.layers.append(np.empty((row["size"].as_py(), row["width"].as_py()), np.int32))
        links = row["links"].values.to_numpy().reshape(-1, row["width"].as_py())
        self.layers[layer][first:first + len(links)] = links

    def answer(self, queries: np.ndarray, k: int, held: int) -> Iterator[tuple[np.ndarray, ...]]:
        """``(query, node, score)`` of the ``k`` best nodes found for each query, some
        queries at a time."""
        if self.graph is None:
            self.graph = Graph(on_a_sphere(self.vectors), self.layers, layer_sizes(len(self.ids)))
        # What the beam keeps of seen points stays below 64 MB.
        some = max(1, min(TOGETHER, (64 << 20) // len(self.ids)))
        scale = np.abs(queries).max(axis=1, keepdims=True)
        asked = np.column_stack([queries / scale, np.zeros(len(queries))]).astype(np.float32)
        for start in range(0, len(queries), some):
            nodes = self.graph.search(asked[start:start + some], max(held, k))
            query, place = np.nonzero(nodes >= 0)
            node = nodes[query, place]
            score = (self.vectors[node] * queries[start + query]).sum(axis=1)
            order = np.lexsort((self.keys[node], self.ids[node], -score, query))
            query, node, score = query[order], node[order], score[order]
            first = np.searchsorted(query, query)
            best = np.arange(len(query)) - first < k
            yield start + query[best], node[best], score[best]


def search_shards(index: DataFrame, asked: DataFrame, k: int, held: int) -> DataFrame:
    """``(query_id, query_key, vec_id, key, score)``: the best ``k`` nodes of each tile for
    the queries ``asked``, blocks in the form of INDEX that are there for every tile."""
    tiles = F.max("tile") + 1
    count = max(1, index.agg(tiles).first()[0] or 0)
    rows = (
        index.union(asked.select(index.columns))
        .repartitionById(min(count, PARTITIONS_MAX), F.col("tile"))
        .sortWithinPartitions("tile", "layer", "first")
    )

    def search(batches):
        shard, tile = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["tile"].as_py() != tile:
                    tile, shard = row["tile"].as_py(), None
                if row["layer"].as_py() != ASKED:
                    shard = shard or Shard.of(row)
                    shard.add(row)
                    continue
                ids, keys = row["ids"].values.to_numpy(), row["keys"].values.to_numpy()
                queries = row["numbers"].values.to_numpy().reshape(len(ids), -1)
                for query, node, score in shard.answer(queries, k, held):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[query]), pa.array(keys[query]), pa.array(shard.ids[node]),
                        pa.array(shard.keys[node]), pa.array(score),
                    ], names=["query_id", "query_key", "vec_id", "key", "score"])

    return rows.mapInArrow(
        search, "query_id long, query_key long, vec_id long, key long, score double"
    )


def query_blocks(queries: DataFrame) -> DataFrame:
    """``queries (first_tile, shards, vec_id, key, vector)`` as blocks in the form of INDEX,
    one copy for each shard of their length."""

    def pack(batches):
        for batch in batches:
            tiles = batch.column(0).to_numpy()
            for tile in np.unique(tiles):
                own = batch.take(pa.array(np.flatnonzero(tiles == tile)))
                ids, keys, vectors = _joined([pa.RecordBatch.from_arrays(
                    [own.column(0), *own.columns[2:]], names=["tile", "vec_id", "key", "vector"])])
                for at in range(0, len(ids), QUERIES):
                    part = slice(at, at + QUERIES)
                    # width holds the number of shards until the copies are made.
                    yield _index_row(int(tile), ASKED, at, len(ids), own.column(1)[0].as_py(),
                                     ids[part], keys[part], vectors[part].reshape(-1), None)

    packed = queries.select("first_tile", "shards", "vec_id", "key", "vector").mapInArrow(pack, INDEX)
    copies = F.explode(F.sequence(F.col("tile"), F.col("tile") + F.col("width") - 1))
    names = [field.split()[0] for field in INDEX.split(", ")]
    return packed.select(copies.alias("copy"), *names[1:]).withColumnRenamed("copy", "tile")


# --- the operator

def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = NEAREST,
                    id_col: str = "vec_id", vector_col: str = "embedding",
                    held: int = HELD, shard_numbers: int = SHARD_NUMBERS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` found nearest to
    each row of ``queries``, by inner product in double precision, best first and the smaller
    id first of equally near ones; all of them where there are fewer.

    Both tables have the columns ``id_col`` and ``vector_col``; a row that has the query's
    id is no candidate for it. Vectors meet those of their own length only. Rows without id
    or whose vector is null, zero, or holds a null or non-finite component take no part. Rows
    that repeat an id with the same vector are one; an id with several vectors has one
    answer, or is one candidate, for each. Equal vectors are one in the graph, however many
    there are. An empty side gives no rows; other columns are not read.

    ``held`` vectors are kept in view on a graph's lowest layer: more of them find more of
    the nearest. A shard has ``shard_numbers`` components at most; there are at least as many
    shards as keep all workers busy.
    """
    rows, asked = (_rows(df, id_col, vector_col) for df in (vectors, queries))
    ids = staged(rows.select("vec_id", "key", "other_key", "size").distinct(), "vector-ids")
    # Of equal vectors the k + 1 smallest ids can be among the nearest k of a query.
    order = Window.partitionBy("size", "key", "other_key").orderBy("vec_id").rowsBetween(
        Window.unboundedPreceding, 0)
    members = staged(
        ids.select("*", F.row_number().over(order).alias("place"),
                   F.first("vec_id").over(order).alias("node"))
        .where(F.col("place") <= k + 1).select("node", "key", "vec_id"),
        "vector-members",
    )
    one = staged(
        rows.groupBy("size", "key", "other_key")
        .agg(F.min("vec_id").alias("vec_id"), F.first("vector").alias("vector"))
        .drop("other_key"),
        "vectors-once",
    )
    shards = _shards(one, shard_numbers)
    spot = F.pmod(F.xxhash64("key", "vec_id"), F.col("shards"))
    dealt = one.join(shards, "size").withColumn("tile", (F.col("first_tile") + spot).cast("int"))
    count = max(1, shards.agg(F.sum("shards")).first()[0] or 0)
    index = staged(
        index_shards(
            dealt.repartitionById(min(count, PARTITIONS_MAX), F.col("tile"))
            .sortWithinPartitions("tile")
        ),
        "graphs",
    )
    blocks = staged(query_blocks(
        asked.dropDuplicates(["vec_id", "size", "key", "other_key"]).join(shards, "size")
    ), "query-blocks")
    found = staged(search_shards(index, blocks, k + 1, held), "shard-answers")

    def best(df: DataFrame, most: int) -> DataFrame:
        place = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)

    nodes = best(found, k + 1).drop("rank").withColumnRenamed("vec_id", "node")
    rows = nodes.join(members, ["node", "key"]).where(F.col("vec_id") != F.col("query_id"))
    return best(rows, k).select("query_id", "rank", "vec_id", "score")


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return rows.select(
        "vec_id", F.col("vector").cast("array<double>").alias("vector"),
        F.size("vector").alias("size"), F.xxhash64("vector").alias("key"),
        F.xxhash64(F.lit(1), "vector").alias("other_key"),
    )


def _shards(one: DataFrame, shard_numbers: int) -> DataFrame:
    """``(size, shards, first_tile)`` of each length that vectors have: the shards of a
    length are the tiles from its first one on."""
    n = F.count("*")
    shards = F.greatest(
        F.ceil(n * F.col("size") / shard_numbers), F.least(F.lit(workers_of(one)), F.ceil(n / SIDE_MIN))
    )
    before = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    counted = one.groupBy("size").agg(shards.cast("int").alias("shards"))
    return staged(
        counted.withColumn("first_tile", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int")),
        "shard-numbers",
    )
