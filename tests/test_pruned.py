import numpy as np
import pytest

from tastegrid.operators import pruned, topn

FACTORS = "id int, features array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], FACTORS)


def scores(df):
    return sorted((r["uid"], r["rank"], r["mid"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    users = [(i, rng.normal(size=6)) for i in range(150)]
    items = [(i, rng.normal(size=6) * rng.pareto(1.5)) for i in range(700)]
    return users, items


def test_the_same_scores_and_most_groups_skipped(spark, vectors):
    users, items = (frame(spark, rows) for rows in vectors)
    found = pruned.pruned_scores(users, items, 10, side=50)
    assert scores(found.scores) == scores(topn.top_scores(users, items, 10))
    assert found.pairs == 150 * 14 and 150 <= found.computed < found.pairs / 2


@pytest.mark.parametrize("side", [1, 7, 10_000])
def test_rated_items_are_left_out(spark, vectors, side):
    users, items = frame(spark, vectors[0][:40]), frame(spark, vectors[1][:60])
    rated = [(u, m) for u in range(40) for m in range(60) if (u * 7 + m) % 3 == 0] + [(1, m) for m in range(60)]
    rated = spark.createDataFrame([*rated, (None, 1), (1, None), (3, 99_999)], "uid int, mid int")
    found = pruned.pruned_scores(users, items, 5, rated, side, user_groups=2)
    want = scores(topn.top_scores(users, items, 5, rated))
    assert scores(found.scores) == want and 1 not in {r[0] for r in want}


def test_ties_across_groups_go_to_the_smaller_id(spark):
    """Equal vectors in several groups, and a shorter one with the same product."""
    items = [(i, (2.0, 0.0)) for i in range(30, 0, -1)] + [(40, (2.0, 5.0)), (0, (2.0, -0.0)), (50, (0.0, 0.0))]
    users = [(1, (1.0, 0.0)), (2, (0.0, 1.0)), (3, (0.0, 0.0)), (4, None), (None, (1.0, 1.0))]
    users, items = frame(spark, users), frame(spark, [*items, (60, None)])
    found = pruned.pruned_scores(users, items, 4, side=3)
    want = scores(topn.top_scores(users, items, 4))
    assert scores(found.scores) == want
    assert [r[2] for r in want if r[0] == 1] == [0, 1, 2, 3]


def test_fewer_items_than_asked_for_and_empty_sides(spark, vectors):
    users, items = frame(spark, vectors[0][:3]), frame(spark, vectors[1][:4])
    assert scores(pruned.pruned_scores(users, items, 10, side=2).scores) == scores(topn.top_scores(users, items, 10))
    for a, b in ((users.limit(0), items), (users, items.limit(0))):
        found = pruned.pruned_scores(a, b)
        assert found.scores.count() == 0 and found.pairs == 0
    lists = {r["uid"]: [x["mid"] for x in r["recs"]] for r in pruned.pruned_topn(users, items, 2).collect()}
    assert lists == {r["uid"]: [x["mid"] for x in r["recs"]] for r in topn.topn_from_factors(users, items, 2).collect()}


def test_a_user_is_one_row_however_many_groups_are_left(spark, monkeypatch):
    """Equally long vectors: no group can be skipped. Users aren't copied to their groups."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(300, 6))
    users = items = frame(spark, [(i, v / np.linalg.norm(v)) for i, v in enumerate(rows)])
    sent, place = [], topn.place_tiles

    def counted(rows, tiles):
        sent.append(rows)
        return place(rows, tiles)
    for module in (topn, pruned):
        monkeypatch.setattr(module, "place_tiles", counted, raising=False)
    found = pruned.pruned_scores(users, items, 5, side=10, user_groups=2)
    assert found.computed > found.pairs / 2
    assert sum(r.count() for r in sent) <= 2 * 300 + 2 * 30 + 30 * 16
    assert scores(found.scores) == scores(topn.top_scores(users, items, 5))
