import hashlib
import math

import numpy as np
import pytest

from tastegrid.llm import centroids
from tastegrid.llm.centroids import cluster_vectors, lower_bounds, pivot_pairs, squared

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, dims=64, clusters=8, rounds=10):
    """The clustering in Python's own whole numbers."""
    kept = [
        (vec_id, [math.floor(1024 * x) for x in v]) for vec_id, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = [row for row in kept if row[0] is not None]
    first = sorted(named, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:clusters]]

    def near(v):
        distances = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres]
        return min(zip(distances, range(len(centres))))

    for _ in range(rounds):
        members = [[v for _, v in kept if near(v)[1] == c] for c in range(len(centres))]
        centres = [
            [sum(column) // len(own) for column in zip(*own)] if own else centre
            for own, centre in zip(members, centres)
        ]
    found = [(vec_id, *near(v)) for vec_id, v in kept]
    inertia = sum(d for _, d, _ in found)
    sums = {c: sum(d for _, d, x in found if x == c) for c in range(len(centres))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], inertia, digests[c]) for i, d, c in found), key=str)


def run(spark, rows, **kwargs):
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in cluster_vectors(vectors, **kwargs).collect()), key=str)


def test_like_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=64)).tolist()) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_ties_copies_and_rows_that_are_left_out(spark):
    ones, half = [1.0] * 64, [0.0] * 32 + [1.0] * 32
    rows = [(i, ones) for i in range(20)] + [(i + 20, half) for i in range(5)]
    rows += [(3, half), (None, half), (None, None), (90, None), (91, [1.0] * 63), (92, ones[:63] + [None]),
             (93, ones[:63] + [float("nan")]), (94, ones[:63] + [float("-inf")]), (95, [0.0] * 64),
             (96, [-1e-9] * 64), (97, [])]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 29


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0] * 64)]])
def test_no_vectors_or_none_with_an_id(spark, rows):
    assert run(spark, rows) == []


def test_fewer_vectors_than_clusters_and_other_parameters(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert run(spark, rows) == brute(rows)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    assert run(spark, rows, dims=3, clusters=4, rounds=3) == brute(rows, 3, 4, 3)
    with pytest.raises(ValueError):
        run(spark, rows, dims=65)


def test_clashing_columns_and_components_too_large(spark):
    vectors = spark.createDataFrame([(1, [0.5] * 64, 1)], SCHEMA).selectExpr(
        "*", "1 AS v", "2 AS cluster", "3 AS to_pivots", "4 AS distance")
    assert cluster_vectors(vectors).first()["distance"] == 0
    with pytest.raises(Exception, match="wouldn't fit"):
        run(spark, [(1, [2e5] + [0.0] * 63)])


def test_bounds_never_exceed_the_distance_and_spare_comparisons():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1024, 1024, (8, 64))
    vectors = np.concatenate([centres[i % 8] + rng.integers(-90, 90, (1, 64)) for i in range(400)])
    pairs = pivot_pairs(centres, 6)
    dist = np.stack([squared(vectors, c) for c in centres], axis=1)
    between = np.sqrt(np.stack([squared(centres, c) for c in centres], axis=1).astype(float))
    for c in range(8):
        low = lower_bounds(np.sqrt(dist.astype(float)), between[c], pairs)
        assert (low <= dist[:, c]).all()
    cluster, best, taken = centroids.nearest(vectors, np.sqrt(dist.astype(float)), centres, between, pairs)
    assert (best == dist.min(axis=1)).all() and (cluster == dist.argmin(axis=1)).all()
    assert taken < 8 * len(vectors) / 2


def test_equal_pivots_bound_nothing():
    pivots = np.ones((3, 4), np.int64)
    assert pivot_pairs(pivots, 6) == []
    assert (lower_bounds(np.ones((2, 3)), np.ones(3), []) == 0).all()
