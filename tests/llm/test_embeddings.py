import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    label = {i: i for i, *_ in rows}
    count = dict.fromkeys(label, 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    def unit(v):
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    for k, (a, va, la) in enumerate(rows):
        for b, vb, lb in rows[:k]:
            if la == lb is not None and len(va) == len(vb) and unit(va) @ unit(vb) >= least:
                count[a] += 1
                count[b] += 1
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (count[i], find(i)) for i in label}


def clustered(rng, n, dims, noise):
    rows = []
    for i in range(n):
        if i % 5 == 0:
            centre = rng.normal(size=dims)
        rows.append((i, (centre + noise * rng.normal(size=dims)).tolist(), int(i // 5 % 3)))
    return rows


def test_recall_against_brute_force(spark, by_id):
    rows = clustered(np.random.default_rng(1), 600, 64, 0.12)
    want = brute(rows)
    found = by_id(embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)))
    links, all_links = sum(r["n_links"] for r in found.values()), sum(n for n, _ in want.values())
    assert all_links > 300 and 0.95 * all_links <= links <= all_links
    assert all(found[i]["n_links"] <= want[i][0] for i in want)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_large_buckets_in_tiles(spark, by_id, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    rows = [(i, (centre + 0.01 * rng.normal(size=32)).tolist(), 1) for i in range(100)]
    found = by_id(embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert {r["n_links"] for r in found.values()} == {99}
    assert {r["component_id"] for r in found.values()} == {0}


def test_unusable_vectors_labels_and_ties(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [
        (1, a, 1), (2, a, 1), (2, a, 1), (3, [2 * x for x in a], 1), (4, a, 2), (5, a, None),
        (6, None, 1), (7, [0.0] * 4, 1), (8, [1.0, None, 3.0, 4.0], 1), (9, [float("nan")] * 4, 1),
        (10, [float("inf"), 1.0, 1.0, 1.0], 1), (11, b, 1), (12, a[:3], 1), (None, a, 1), (13, [], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(0)).withColumn("h1", F.lit(0))
    out = [tuple(r) for r in embeddings.near_vectors(df).collect()]
    assert len(out) == len(rows)
    assert sorted(r for r in out if r[0] in (1, 2, 3)) == [
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    rest = [r for r in out if r[0] not in (1, 2, 3)]
    assert all(r[1] == 0 and r[2] == r[0] and r[3] for r in rest)


def test_doubles_and_an_empty_table(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert embeddings.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1e300, 1e300], "x"), (2, [1e-300, 1e-300], "x"), (3, [1.0, 0.0], "x")]
    out = sorted(tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert out == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_rotation_balances_bits():
    rng = np.random.default_rng(4)
    vectors = embeddings.units(rng.normal(size=(3000, 24)) @ rng.normal(size=(24, 24)))
    projection = embeddings.fit_rotation(vectors, 16)
    share = (vectors @ projection >= 0).mean(axis=0)
    assert 0.3 < share.min() and share.max() < 0.7
    assert projection.T @ projection == pytest.approx(np.eye(16), abs=1e-9)


@pytest.mark.parametrize("dims, bits, tables", [(64, 11, 7), (64, 16, 11), (10, 12, 3), (4, 10, 6), (1, 10, 2)])
def test_substrings_are_bits_of_their_own(dims, bits, tables):
    rng = np.random.default_rng(1)
    vectors = embeddings.units(rng.normal(size=(500, dims)))
    rotations = embeddings.fit_rotations(vectors, bits, tables)
    keys = embeddings.substrings(vectors, rotations, bits, tables)
    assert keys.shape == (500, tables) and 0 <= keys.min() and keys.max() < 1 << min(bits, dims)
    if dims > 4:
        assert len({tuple(column) for column in keys.T}) == tables


def test_the_plan_follows_the_number_of_vectors():
    plans = [embeddings.table_plan(n, 0.98) for n in (0, 1, 5_000, 10**6, 10**9)]
    assert plans == [(10, 7), (10, 7), (11, 7), (18, 13), (28, 27)]
    assert embeddings.table_plan(100, 1.0) == (10, 1)


@pytest.mark.parametrize("n", [10_000, 160_000])
def test_comparisons_for_a_vector_and_recall_at_two_sizes(n):
    """Random vectors of one label, and pairs just at the least cosine among them."""
    rng = np.random.default_rng(n)
    vectors = embeddings.units(rng.normal(size=(n, 64)))
    other = embeddings.units(rng.normal(size=(500, 64)))
    other -= (other * vectors[:500]).sum(axis=1, keepdims=True) * vectors[:500]
    near = 0.98 * vectors[:500] + np.sqrt(1 - 0.98**2) * embeddings.units(other)
    bits, tables = embeddings.table_plan(n, 0.98)
    rotations = embeddings.fit_rotations(vectors[:5000], bits, tables)
    keys = embeddings.substrings(vectors, rotations, bits, tables)
    met = (keys[:500] == embeddings.substrings(near, rotations, bits, tables)).any(axis=1)
    counts = [np.unique(column, return_counts=True)[1] for column in keys.T]
    compared = sum(float((c * (c - 1.0)).sum()) for c in counts) / n
    assert met.mean() >= 0.97 and compared < 60
