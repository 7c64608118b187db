import numpy as np
import pyarrow as pa
import pytest

from tastegrid.functions.blocks import matrix
from tastegrid.operators import topn
from tastegrid.operators.fallback import exclude_seen, user_recs_with_fallback
from tastegrid.operators.popularity import hot_items, popular_places
from tastegrid.sources.tables import publish_user_recs

FACTORS = "id int, features array<float>"


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(3)
    return rng.normal(size=(50, 6)).astype(np.float32), rng.normal(size=(130, 6)).astype(np.float32)


def frames(frame, sides):
    return [frame([(i, [float(x) for x in row]) for i, row in enumerate(side)], FACTORS)
            for side in sides]


def brute(sides, k, seen=()):
    u, v = (s.astype(float) for s in sides)
    scores = np.round(u @ v.T, 9)
    out = {}
    for i in range(len(u)):
        line = sorted((-scores[i, j], j) for j in range(len(v)) if (i, j) not in seen)[:k]
        out[i] = [j for _, j in line]
    return out


def lists(df):
    return {r["uid"]: [x["mid"] for x in r["recs"]] for r in df.collect()}


@pytest.mark.parametrize("groups", [(None, None), (1, 1), (3, 2), (2, 5)])
@pytest.mark.parametrize("k", [1, 10, 200])
def test_lists_equal_brute_force(frame, sides, groups, k):
    users, items = frames(frame, sides)
    assert lists(topn.topn_from_factors(users, items, k, None, *groups)) == brute(sides, k)


@pytest.mark.parametrize("groups", [(1, 1), (3, 4)])
def test_excluded_pairs_leave_before_the_cut(frame, sides, groups):
    """User 0 has rated all items but two, user 1 all of them; some pairs repeat,
    and some name unknown users and items."""
    users, items = frames(frame, sides)
    rng = np.random.default_rng(4)
    seen = {(0, j) for j in range(128)} | {(1, j) for j in range(130)}
    seen |= {(int(a), int(b)) for a, b in rng.integers(0, 60, size=(400, 2))}
    rated = frame([*seen, *seen, (7, 999), (999, 7), (None, 1), (1, None)], "uid int, mid int")
    want = {u: line for u, line in brute(sides, 10, seen).items() if line}
    got = lists(topn.topn_from_factors(users, items, 10, rated, *groups))
    assert got == want and len(got[0]) == 2 and 1 not in got


def test_factor_scores_are_inner_products(frame, sides):
    users, items = frames(frame, sides)
    asked = frame([(0, 0), (3, 129), (99, 1), (1, 999)], "uid int, mid int")
    got = {(r["uid"], r["mid"]): r["prediction"]
           for r in topn.factor_scores(asked, users, items).collect()}
    u, v = (s.astype(float) for s in sides)
    assert got == {(0, 0): pytest.approx(u[0] @ v[0]), (3, 129): pytest.approx(u[3] @ v[129])}


def test_exclude_seen_pairs(frame):
    left = frame([(1, 1), (1, 2), (2, 1)], "uid int, mid int")
    rated = frame([(1, 1, 3.0), (1, 1, 4.0), (2, 2, 1.0)], "uid int, mid int, score double")
    assert sorted(tuple(r) for r in exclude_seen(left, rated).collect()) == [(1, 2), (2, 1)]


RECS = "uid int, recs array<struct<mid:int,score:double>>"


def test_unknown_users_get_the_popular_items(frame):
    ratings = frame([(1, 5, 1.0), (2, 5, 1.0), (1, 4, 1.0)], "uid int, mid int, score double")
    users = frame([(1, "a"), (2, "b")], "id int, username string")
    recs = frame([(1, [(9, 4.5)])], RECS)
    got = {r["uid"]: ([tuple(x) for x in r["recs"]], r["is_fallback"])
           for r in user_recs_with_fallback(users, recs, hot_items(ratings), 2).collect()}
    assert got == {1: ([(9, 4.5)], False), 2: ([(5, 5.0), (4, 5.0)], True)}


def test_fallback_lists_have_k_items(frame):
    ratings = frame([(1, i, 1.0) for i in range(20)], "uid int, mid int, score double")
    users, recs = frame([(2, "b")], "id int, username string"), frame([], RECS)
    for k in (3, 10):
        row = user_recs_with_fallback(users, recs, popular_places(ratings), k).first()
        assert [x["mid"] for x in row["recs"]] == list(range(k))


def test_rows_without_id_or_vector_are_left_out(frame):
    schema = "id int, features array<double>"
    sides = [frame([(1, [1.0, 2.0]), (None, [1.0, 1.0]), (2, None)], schema) for _ in range(2)]
    assert [(r["uid"], r["mid"]) for r in topn.top_scores(*sides, 5).collect()] == [(1, 1)]


def test_vectors_of_different_lengths_are_refused():
    with pytest.raises(ValueError):
        matrix(pa.array([[1.0], [1.0, 2.0, 3.0]]))


def test_publish(frame):
    recs = frame([(1, [(9, 4.5), (3, 4.0)]), (2, [])], RECS)
    assert {tuple(r) for r in publish_user_recs(recs).collect()} == {(1, "9,3"), (2, "")}


def rows_in_tiles(monkeypatch, make):
    """How many rows ``make()`` sends to tiles."""
    sent, place = [], topn.place_tiles

    def counted(rows, tiles):
        sent.append(rows)
        return place(rows, tiles)
    monkeypatch.setattr(topn, "place_tiles", counted)
    make().count()
    return sum(rows.count() for rows in sent)


def test_items_travel_in_blocks(spark, monkeypatch):
    """A user is one row, and an item isn't a row for each group of users."""
    users, items = (
        spark.range(n).selectExpr("cast(id AS int) AS id", "array(cast(id % 7 AS float), cast(1 AS float)) AS features")
        for n in (3000, 6000))
    sent = rows_in_tiles(monkeypatch, lambda: topn.top_scores(users, items, 3, user_groups=4, item_groups=1))
    assert sent <= 3000 + 4 * 200 * 1.5
    best = topn.top_scores(users, items, 3, user_groups=4, item_groups=1).where("uid = 8").orderBy("rank")
    assert [(r["mid"], r["score"]) for r in best.collect()] == [(6, 7.0), (13, 7.0), (20, 7.0)]


def test_repeated_users_and_items_stay_repeated(frame):
    """Every id twice, and a hundred equal vectors, which tie by id."""
    rows = [(i % 5, [float(i % 5), 1.0]) for i in range(10)]
    items = [(i // 2, [1.0, float(i % 2)]) for i in range(20)] + [(100 + i, [1.0, 0.0]) for i in range(100)]
    got = topn.top_scores(frame(rows, FACTORS), frame(items, FACTORS), 12, None, 2, 2).where("uid = 4")
    found = [(r["mid"], r["score"]) for r in got.orderBy("rank").collect()]
    assert found == [(i // 2, 5.0) for i in range(12)]


@pytest.mark.parametrize("size", [1, 3, 7, 1024])
def test_blocks_hold_every_vector_once(monkeypatch, size):
    """Blocks are of one group, not longer than they may be, and equal ids share one."""
    monkeypatch.setattr(topn, "BLOCK_ITEMS", size)
    rows = [(g, i // 2) for g in range(3) for i in range(20 + g)]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([i for _, i in part], pa.int32()),
             pa.array([[float(g), float(i)] for g, i in part], pa.list_(pa.float32())),
             pa.array([g for g, _ in part], pa.int32()), pa.array([None] * len(part), pa.float64())],
            names=["id", "features", "grp", "bound"])
        for part in (rows[:11], rows[11:12], rows[12:])
    ]
    found = [row for block in topn._packed(iter(batches)) for row in block.to_pylist()]
    assert [(b["grp"], i) for b in found for i in b["ids"]] == rows
    assert [x for b in found for x in b["features"]] == [float(x) for row in rows for x in row]
    assert all(len(b["ids"]) <= max(size, 2) for b in found)
    held = [(b["grp"], i) for b in found for i in set(b["ids"])]
    assert len(held) == len(set(held))
