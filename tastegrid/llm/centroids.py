"""Centroid clustering with exact assignments, spared by Ptolemy's inequality.

For any four points x, c, p, s the products of opposite sides bound the product of the
diagonals: |xp| |cs| <= |xc| |ps| + |xs| |cp|. With a fixed pair of pivots p, s the
distances of every vector to the pivots are taken once and stored; then

    |xc| >= | |xp| |cs| - |xs| |cp| | / |ps|

bounds the distance to any centroid c without a look at the vector. The bound is rounded
down, and the centroids that it leaves are compared exactly, in whole numbers.
"""

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stages import staged

SCALE, CLUSTERS, ROUNDS, SEED = 1024, 8, 10, 3
# Pivots, and pairs of them whose bounds are taken.
PIVOTS, PAIRS = 8, 6
# A component lies between -LARGEST and LARGEST: a squared distance of so many components
# then fits in a long.
LARGEST, WIDEST = 1 << 27, 64
# Relative error that is granted to a bound, far above that of the few roundings in it.
SLACK = 1e-12

Matrix = np.ndarray


# --- vectors

def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int,
                  scale: int) -> DataFrame:
    """``(vec_id, v)``: the vectors of ``dims`` finite components, each turned into the
    whole number below ``scale`` times it."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    kept = vectors.where(F.coalesce((F.size(vector) == dims) & finite, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def starting_centroids(whole: DataFrame, clusters: int, seed: int) -> Matrix:
    """The vectors whose ids have the smallest hashes, in the order of the hashes; rows
    without id are none. They are ``clusters`` at most, so the driver may hold them."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.where("vec_id is not null").orderBy(place, "v").limit(clusters).select("v")
    rows = [row["v"] for row in first.collect()]
    return np.array(rows, np.int64) if rows else np.empty((0, 0), np.int64)


def _vectors(column: pa.Array, dims: int) -> Matrix:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def squared(vectors: Matrix, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors to one point."""
    differ = vectors - point
    return np.einsum("ij,ij->i", differ, differ)


# --- bounds

def pivot_pairs(pivots: Matrix, pairs: int) -> list[tuple[int, int, float]]:
    """``(p, s, |ps|)`` of the pairs of pivots farthest apart; equal pivots bound nothing."""
    found = []
    for p, s in combinations(range(len(pivots)), 2):
        gap = int(squared(pivots[p:p + 1], pivots[s])[0])
        if gap:
            found.append((-gap, p, s))
    return [(p, s, float(np.sqrt(-gap))) for gap, p, s in sorted(found)[:pairs]]


def lower_bounds(to_pivots: np.ndarray, centre_to_pivots: np.ndarray,
                 pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """A lower bound of the squared distance of each vector to one centroid, from the
    distances of both to the pivots. What rounding may have added is taken off."""
    low = np.zeros(len(to_pivots))
    for p, s, gap in pairs:
        one, other = to_pivots[:, p] * centre_to_pivots[s], to_pivots[:, s] * centre_to_pivots[p]
        np.maximum(low, (np.abs(one - other) - SLACK * (one + other)) / gap, out=low)
    return low * low * (1 - 4 * SLACK)


def nearest(vectors: Matrix, to_pivots: np.ndarray, centres: Matrix, centre_to_pivots: np.ndarray,
            pairs: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid, the smaller number of equally near ones, its exact
    squared distance, and how many distances were taken in all.

    The centroid of the least bound comes first; any other is compared where its bound
    isn't above the best distance so far.
    """
    low = np.stack([lower_bounds(to_pivots, own, pairs) for own in centre_to_pivots], axis=1)
    cluster = low.argmin(axis=1)
    best = np.empty(len(vectors), np.int64)
    for c in range(len(centres)):
        at = np.flatnonzero(cluster == c)
        best[at] = squared(vectors[at], centres[c])
    first, taken = cluster.copy(), len(vectors)
    for c in range(len(centres)):
        at = np.flatnonzero((first != c) & (low[:, c] <= best.astype(float) * (1 + SLACK)))
        own = squared(vectors[at], centres[c])
        taken += len(at)
        nearer = (own < best[at]) | ((own == best[at]) & (c < cluster[at]))
        best[at[nearer]], cluster[at[nearer]] = own[nearer], c
    return cluster, best, taken


# --- rounds

def with_pivots(whole: DataFrame, pivots: Matrix) -> DataFrame:
    """``whole`` with each vector's distances to the pivots, taken once for all rounds."""
    dims = pivots.shape[1]

    def measure(batches):
        for batch in batches:
            vectors = _vectors(batch.column(1), dims)
            if np.abs(vectors).max(initial=0) >= LARGEST:
                raise ValueError(f"a component times the scale is {LARGEST} or more: "
                                 "squared distances wouldn't fit in a long")
            to_pivots = np.sqrt(np.stack([squared(vectors, p) for p in pivots], axis=1).astype(float))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(to_pivots)], names=["vec_id", "v", "to_pivots"])

    return whole.mapInArrow(measure, "vec_id long, v array<long>, to_pivots array<double>")


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, columns = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * columns)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


class Assignment:
    """The centroids of a round and what their bounds need: a few kB sent with each task."""

    def __init__(self, centres: Matrix, pivots: Matrix):
        self.centres = centres
        self.to_pivots = np.sqrt(np.stack([squared(centres, p) for p in pivots], axis=1).astype(float))
        self.pairs = pivot_pairs(pivots, PAIRS)

    def of(self, batch: pa.RecordBatch) -> tuple[Matrix, np.ndarray, np.ndarray, int]:
        vectors = _vectors(batch.column("v"), self.centres.shape[1])
        pivots = self.to_pivots.shape[1]
        to_pivots = batch.column("to_pivots").flatten().to_numpy(zero_copy_only=False)
        return vectors, *nearest(
            vectors, to_pivots.reshape(-1, pivots), self.centres, self.to_pivots, self.pairs)


def moved(measured: DataFrame, pivots: Matrix, centres: Matrix) -> Matrix:
    """The centroids after one round: each component the whole number below the mean of
    its cluster. Tasks hand on one sum for each cluster and component, whatever the size
    of a cluster."""
    clusters, dims = centres.shape
    work = Assignment(centres, pivots)

    def add_up(batches):
        # Python's own whole numbers: sums of any length stay exact.
        sums, counts = np.zeros((clusters, dims), object), [0] * clusters
        for batch in batches:
            vectors, cluster, _, _ = work.of(batch)
            for c in np.unique(cluster):
                own = vectors[cluster == c]
                sums[c] += own.sum(axis=0)
                counts[c] += len(own)
        rows = [(c, d, sums[c, d], counts[c]) for c in range(clusters) if counts[c] for d in range(dims)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
            pa.array(columns[2], pa.decimal128(38)) if rows else pa.array([], pa.decimal128(38)),
            pa.array(columns[3], pa.int64()),
        ], names=["cluster", "dim", "total", "n"])

    sums = measured.select("v", "to_pivots").mapInArrow(
        add_up, "cluster int, dim int, total decimal(38,0), n long"
    ).groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centres.copy()
    for row in sums.collect():  # clusters x components
        out[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]
    return out


def assigned(measured: DataFrame, pivots: Matrix, centres: Matrix) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector; ``compared`` counts the distances
    taken for its batch, in the batch's first row, and is 0 in the others."""
    work = Assignment(centres, pivots)

    def assign(batches):
        for batch in batches:
            if not len(batch):
                continue
            _, cluster, distance, taken = work.of(batch)
            compared = np.zeros(len(batch), np.int64)
            compared[0] = taken
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance),
                 pa.array(compared)], names=["vec_id", "cluster", "distance", "compared"])

    return measured.mapInArrow(assign, "vec_id long, cluster int, distance long, compared long")


# --- the operator

def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    dims: int = WIDEST, scale: int = SCALE, clusters: int = CLUSTERS,
                    rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per vector of ``dims`` finite components: vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256.

    Components are whole numbers, ``floor(scale * x)``. The starting centroids are the
    vectors with the smallest ``sha256('seed:vec_id')``; each round assigns every vector to
    the nearest centroid, the smaller number of equally near ones, and replaces every
    centroid that has vectors by the floor of their mean. ``distance`` is the exact squared
    distance to the cluster's last centroid, an inertia the sum of them, and
    centroid_sha256 is taken over the centroid's components joined by commas.

    Vectors that are null, of another length, or hold a null or non-finite component are
    left out. Rows without id are clustered, but don't start a centroid; rows that share an
    id are clustered each, and equal starting vectors leave the later centroids empty, where
    they stay. With fewer vectors than clusters each starts one. Without any, or without an
    id, the result is empty. A component of ``LARGEST / scale`` or more is an error, since
    squared distances would not fit in a long. Other columns are not read.
    """
    if not 1 <= dims <= WIDEST:
        raise ValueError(f"dims is from 1 to {WIDEST}")
    whole = whole_vectors(vectors, id_col, vector_col, dims, scale)
    centres = starting_centroids(whole, clusters, seed)
    if not len(centres):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    pivots = centres[:PIVOTS]
    measured = staged(with_pivots(whole, pivots), "pivot-distances")
    for _ in range(rounds):
        centres = moved(measured, pivots, centres)
    found = staged(assigned(measured, pivots, centres), "clusters").drop("compared")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    own = {row["cluster"]: int(row["total"]) for row in sums.collect()}  # one row per cluster
    about = vectors.sparkSession.createDataFrame(
        [(c, total, sum(own.values()), centroid_digest(centres[c])) for c, total in own.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def centroid_digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()
