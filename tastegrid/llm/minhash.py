"""Near-duplicates by a chosen-path set similarity join.

Documents go down several independent trees. At a node, minwise values chosen by the
node's own hash tell which children a document goes to, so that similar documents go
the same way. A node with few documents is a leaf, whose documents are compared with
each other by sketch; a node with many branches on, down to the last level, where it
is compared in tiles. What looks alike is confirmed on the full sets of shingles.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .stages import staged
from .components import components
from .runs import roots, runs, slices
from .words import SPACES, Words, mix, pairs, words_of

# Minwise values of a document, and the similarity in percent that makes a link.
VALUES, PERCENT = 64, 80
# A child on a second value is chosen at a quarter of the nodes: 1.25 children per node
# and document, so that a pair at the threshold shares one child, on average.
SECOND = 4
LEAF, LEVELS = 64, 4
# The part of pairs exactly at the threshold that the trees are to find.
RECALL = 0.999
# Equal sketch bytes below which two documents are no candidates: four deviations
# below what a pair at the threshold has.
SKETCH_LEAST = 38
# Documents of a group in a tile of a leaf; documents and shingles of one in a cluster.
TILE, CLUSTER_TILE, CLUSTER_SHINGLES = 512, 256, 1 << 21
# Slots that ids are hashed to, to find texts that can be left out of a shuffle.
SLOTS = 1 << 20

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(1, 1 << 63, VALUES, dtype=np.uint64)
_OTHER = np.uint64(0x2545F4914F6CDD1D)


def trees_for(recall: float, percent: int = PERCENT, levels: int = LEVELS) -> int:
    """Trees with which a pair at the threshold meets in a leaf with probability
    ``recall``, even if all its nodes branch down to the last level."""
    share, reached = percent / 100, 1.0
    for _ in range(levels):
        reached = 1 - (1 - share * reached) * (1 - share * reached / SECOND)
    return math.ceil(math.log(1 - recall) / math.log(1 - reached))


# --- sets inside a task

def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's 2-word shingles; a single word is a
    shingle of its own."""
    hashes, first = pairs(words)
    sets = []
    for i, count in enumerate(words.counts()):
        if count == 1:
            sets.append(mix(words.hash[words.first[i]:words.first[i] + 1] ^ _OTHER))
        else:
            sets.append(np.unique(hashes[first[i]:first[i + 1]]))
    return sets


def minwise(hashes: np.ndarray) -> np.ndarray:
    """VALUES minwise values of 32 bits."""
    low = np.full(VALUES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        part = hashes[at:at + 2048, None] * _FACTORS
        part ^= _SHIFTS
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` with the size of its set, a 128-bit digest of the set, its
    minwise values (null for an empty set) and one byte of each as a sketch."""

    def sign(batches):
        for batch in slices(batches, 1):
            sets = shingle_sets(words_of(batch.column(1), SPACES))
            full = [len(s) > 0 for s in sets]
            values = [minwise(s) if some else None for s, some in zip(sets, full)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(_signed([mix(s).sum(dtype=np.uint64) for s in sets])),
                pa.array(_signed([mix(s ^ _OTHER).sum(dtype=np.uint64) for s in sets])),
                pa.array([None if v is None else v.view(np.int32) for v in values],
                         pa.list_(pa.int32())),
                pa.array([None if v is None else (v & 255).astype(np.uint8).tobytes()
                          for v in values], pa.binary()),
            ], names=["doc_id", "n_shingles", "d1", "d2", "sig", "sketch"])

    return docs.mapInArrow(
        sign, "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>, sketch binary"
    )


# --- trees

def branch(rows: DataFrame) -> DataFrame:
    """``(node, doc_id)`` of the children that the rows ``(node, doc_id, sig)`` go to."""
    def draw(salt: int, of: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(of)).cast("int")

    second = F.when(draw(1, SECOND) == 0, draw(2, VALUES))
    chosen = F.array_distinct(F.array_compact(F.array(draw(0, VALUES), second)))
    return rows.select("node", "doc_id", "sig", F.explode(chosen).alias("at")).select(
        F.xxhash64("node", "at", F.element_at("sig", F.col("at") + 1)).alias("node"), "doc_id"
    )


def leaves(signed: DataFrame, trees: int, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """``(node, doc_id, n)`` of the leaves with two documents or more, n being how many."""
    roots_of = F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    members = branch(
        signed.select("doc_id", "sig", roots_of).withColumn("node", F.xxhash64("tree"))
    )
    found = []
    for level in range(1, levels + 1):
        counts = staged(
            members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "path-counts"
        )
        shared = staged(members.join(counts, "node"), "path-shared")
        if level == levels:
            found.append(shared)
            break
        found.append(shared.where(F.col("n") <= leaf))
        large = shared.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        members = branch(large.join(signed.select("doc_id", "sig"), "doc_id"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def tiles(rows: DataFrame, group: str, groups: Column) -> DataFrame:
    """``rows`` with a ``tile``, so that any two rows of a ``group`` share one. The rows
    are dealt by id to ``groups`` parts, and a tile is a pair of parts."""
    parts = groups.cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit(3)), parts).cast("int")
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("tile", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))
    )


def candidates(found: DataFrame, signed: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the documents of each leaf whose sketches are alike; as
    many as needed to connect them, not one for each pair."""
    rows = (
        tiles(found.join(signed.select("doc_id", "sketch"), "doc_id"), "node",
              F.ceil(F.col("n") / TILE))
        .select("tile", "doc_id", "sketch").repartition("tile").sortWithinPartitions("tile")
    )

    def compare(batches):
        parts = (
            (b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)))
            for b in batches
        )
        out = []
        for _, ids, sketches in runs(parts):
            if len(ids) < 2:
                continue
            links = np.empty((len(ids), len(ids)), bool)
            for at in range(0, len(ids), 64):
                equal = sketches[at:at + 64, None] == sketches[None]
                links[at:at + 64] = equal.sum(axis=2, dtype=np.uint8) >= SKETCH_LEAST
            out.append(_forest(ids, links))
            if sum(map(len, out)) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return rows.mapInArrow(compare, "a long, b long")


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, VALUES)


def _forest(ids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Edges of each component of the symmetric ``links`` to its smallest id."""
    order = np.argsort(ids, kind="stable")
    ids, root = ids[order], roots(links[order][:, order])
    moved = ids[root] != ids
    return np.stack([ids[moved], ids[root[moved]]], axis=1)


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    edges = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(edges[:, 0].copy(), pa.int64()), pa.array(edges[:, 1].copy(), pa.int64())],
        names=["a", "b"],
    )


# --- full sets

def confirmed(docs: DataFrame, clusters: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect the documents of each cluster whose full sets are alike.

    ``clusters (doc_id, cluster, n_shingles)``. Every two documents of a cluster are
    compared, in tiles; a tile stops where all that it holds is connected.
    """
    sizes = staged(
        clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")),
        "cluster-sizes",
    )
    groups = F.greatest(F.ceil(F.col("n") / CLUSTER_TILE), F.ceil(F.col("m") / CLUSTER_SHINGLES))
    placed = staged(
        tiles(clusters.join(sizes, "cluster"), "cluster", groups).select("doc_id", "tile"),
        "cluster-tiles",
    )
    # Most documents are in no cluster. Which of SLOTS slots have one is a table of
    # proven size, so it can go to every executor; the texts of the other slots are
    # left out before the shuffle.
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    used = staged(clusters.select(slot.alias("slot")).distinct(), "cluster-slots")
    near = docs.withColumn("slot", slot).join(F.broadcast(used), "slot", "left_semi")
    rows = (
        near.join(placed, "doc_id").select("tile", "doc_id", "text")
        .repartition("tile").sortWithinPartitions("tile")
    )

    def compare(batches):
        def parts():
            for batch in slices(batches, 2):
                sets = np.empty(len(batch), object)
                sets[:] = shingle_sets(words_of(batch.column(2), SPACES))
                yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), sets

        out = []
        for _, ids, sets in runs(parts()):
            if len(ids) > 1:
                out.append(_forest(ids, similar_sets(sets, percent)))
            if sum(map(len, out)) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return rows.mapInArrow(compare, "a long, b long")


def similar_sets(sets: np.ndarray, percent: int) -> np.ndarray:
    """The symmetric matrix of links between sets: 100 * intersection >= percent * union.
    Left off once all sets are connected: what it holds then connects them."""
    sizes = np.array([len(s) for s in sets])
    links = np.zeros((len(sets), len(sets)), bool)
    if not sizes.any():
        return links
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    filled = np.flatnonzero(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(values), np.int32)
    reached = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        if not sizes[i]:
            continue
        own = place[first[i]:first[i + 1]]
        marked[own] = 1
        common = np.zeros(len(sets), np.int64)
        common[filled] = np.add.reduceat(marked[place], first[filled])
        marked[own] = 0
        links[i] = (common > 0) & (100 * common >= percent * (sizes + sizes[i] - common))
        links[:, i] |= links[i]
        if i == 0 or reached[i]:
            reached |= links[i]
        if reached.all():
            break
    return links


# --- the operator

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is that of its distinct 2-word shingles, of words between white
    space with A-Z lower-cased; of one word, that word. Two documents are linked when
    100 * intersection >= ``percent`` * union; component_id is the smallest id
    reachable by links, and the document of that id is kept.

    Empty and null texts have an empty set and are linked with nothing. Equal sets are
    one document to the trees, however many there are. A row without id is linked with
    nothing, has no component and is kept. Rows that share an id are linked by it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = staged(signatures(docs), "signatures")
    usable = every.where("n_shingles > 0 and doc_id is not null")
    # One document stands for all with its set.
    best = F.min_by(F.struct("sig", "sketch"), "doc_id").alias("best")
    one = staged(
        usable.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), best)
        .select("doc_id", "n_shingles", "d1", "d2", "best.sig", "best.sketch"),
        "one-of-each-set",
    )
    looks = components(candidates(leaves(one, trees_for(recall, percent)), one))
    clusters = staged(
        looks.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
        .join(one.select("doc_id", "n_shingles"), "doc_id"),
        "clusters",
    )
    linked = components(confirmed(docs, clusters, percent))
    component = F.coalesce("component", "least_id")
    classes = staged(
        one.select("n_shingles", "d1", "d2", F.col("doc_id").alias("least_id"))
        .join(linked.withColumnRenamed("id", "least_id"), "least_id", "left")
        .select("n_shingles", "d1", "d2", component.alias("component_id")),
        "set-classes",
    )
    alone = every.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return (
        usable.join(classes, ["n_shingles", "d1", "d2"])
        .select("doc_id", "n_shingles", "component_id").union(alone)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         **options) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns kept.
    The documents that go are the shorter list, so they are the side looked up."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept")
    return docs.join(staged(gone.select(F.col("doc_id").alias(id_col)), "near-gone"),
                     id_col, "left_anti").select(*docs.columns)
