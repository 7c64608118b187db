import numpy as np
import pytest

from tastegrid.llm import hnsw
from tastegrid.llm.hnsw import build_graph, layer_sizes, nearest_vectors, on_a_sphere
from tastegrid.llm.queries import op12_hnsw
from tastegrid.llm.tables import table

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, queries, k=20):
    """(query_id, rank, vec_id, score) over all rows, one after the other."""
    def usable(rows):
        return [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
                and np.isfinite(v).all() and np.any(v)]
    out = []
    for query_id, query in usable(queries):
        scored = {(i, tuple(v)): float((query * v).sum()) for i, v in usable(rows)
                  if i != query_id and len(v) == len(query)}
        best = sorted(((s, i) for (i, _), s in scored.items()), key=lambda x: (-x[0], x[1]))[:k]
        out += [(query_id, rank, i, score) for rank, (score, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, queries, **kwargs):
    frames = [spark.createDataFrame([(i, v, 1) for i, v in r], SCHEMA) for r in (rows, queries)]
    return sorted(tuple(r) for r in nearest_vectors(*frames, **kwargs).collect())


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


def test_shards_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.2, 3)).tolist()) for i in range(4000)]
    queries = [r for r in rows if r[0] % 20 == 0]
    got, want = run(spark, rows, queries, shard_numbers=16_000), brute(rows, queries)
    assert recall(got, want) > 0.97 and len(got) == len(want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(scores.get((q, i), s) == s for q, _, i, s in got)


def test_the_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    got = [tuple(r) for r in op12_hnsw(spark, sf).collect()]
    assert recall(got, want) > 0.98 and len(got) == len(want)


def test_copies_ties_and_rows_that_take_no_part(spark):
    same, other = [1.0, 2.0], [2.0, 1.0]
    rows = [(i, same) for i in range(1, 60)] + [(i + 100, other) for i in range(30)] + [(5, other)]
    rows += [(300, None), (301, [0.0, 0.0]), (302, [1.0, None]), (303, [float("nan"), 1.0]), (None, same),
             (304, [1.0, 2.0, 3.0]), (305, [9.0]), (306, [float("inf"), 1.0]), (307, []), (308, [-1.0, -9.0])]
    rows += rows[:3]
    queries = [(40, same), (305, [9.0]), (304, [1.0, 2.0, 3.0]), (999, [1.0, 1.0]), (300, None), (40, same)]
    assert run(spark, rows, queries) == brute(rows, queries[:-1])
    assert {q for q, *_ in run(spark, rows, queries)} == {40, 999}


def test_fewer_candidates_than_asked_for_and_empty_sides(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 8)]
    assert run(spark, rows, rows[:2]) == brute(rows, rows[:2])
    assert run(spark, rows, []) == [] and run(spark, [], rows) == []


def test_clashing_columns_and_float_vectors(spark):
    rows = [(i, [float(i), 1.0], 1) for i in range(1, 80)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS tile", "2 AS key", "3 AS size", "4 AS shards")
    got = sorted(tuple(r) for r in nearest_vectors(vectors, vectors.where("vec_id = 7"), k=3).collect())
    assert got == [(7, 1, 79, 554.0), (7, 2, 78, 547.0), (7, 3, 77, 540.0)]


def test_links_of_a_graph():
    vectors = np.random.default_rng(8).normal(size=(3000, 12))
    graph = build_graph(vectors)
    assert graph.sizes == layer_sizes(3000) and len(graph.layers) == len(graph.sizes) - 1
    for links, n in zip(graph.layers, graph.sizes):
        assert links.max() < n and not (links == np.arange(n)[:, None]).any()
        for row in links:
            some = row[row >= 0]
            assert len(some) and len(set(some.tolist())) == len(some)


def test_largest_products_are_nearest_on_the_sphere():
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(50, 6)) * rng.uniform(0.1, 1e200, (50, 1))
    points = on_a_sphere(vectors)
    assert np.allclose((points * points).sum(axis=1), 1, atol=1e-5)
    query = rng.normal(size=6)
    order = np.argsort(-(points[:, :-1] @ query))
    assert (order[:10] == np.argsort(-(vectors @ query))[:10]).all()


@pytest.mark.parametrize("held", [64, 256])
def test_more_vectors_in_view_find_more(held):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(5000, 48))
    graph = build_graph(vectors)
    queries = vectors[:100]
    asked = np.column_stack([queries, np.zeros(100)]).astype(np.float32)
    got = graph.search(asked, held)[:, :20]
    want = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    share = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got.tolist(), want.tolist())])
    assert share > (0.6 if held == 64 else 0.9)
