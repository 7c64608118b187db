"""What queries send and keep on disk: no more than their work needs."""

import re

import numpy as np
import pytest

from tastegrid.operators import model
from tastegrid.plans import workload


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders, their lines and vectors, in a folder of their own."""
    at, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(3)
    orders = [(o, int(u)) for o, u in enumerate(rng.integers(1, 41, 400))]
    lines = [(o, int(m), float(q)) for o in range(400)
             for m, q in zip(rng.integers(1, 31, 3), rng.integers(1, 51, 3))]
    vectors = [(i, rng.standard_normal(4).astype(float).tolist()) for i in range(60)]
    for rows, schema, name in (
        (orders, "o_orderkey bigint, o_custkey bigint", "orders"),
        (lines, "l_orderkey bigint, l_partkey bigint, l_quantity double", "lineitem"),
        (vectors, "vec_id bigint, embedding array<float>", "embeddings"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def names(plan):
    children = plan.children()
    return [plan.nodeName()] + [n for i in range(children.size()) for n in names(children.apply(i))]


def test_pairs_without_rated_ones_are_not_stored_before_their_shuffle(spark, tables, monkeypatch):
    stored = []
    monkeypatch.setattr(workload, "staged", lambda df, name: stored.append(name) or df)
    found = {tuple(row) for row in workload.exclude_seen_pairs(spark, tables).collect()}
    assert stored == []
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    rated = {(r["uid"], r["mid"]) for r in workload.views.ratings(spark, tables).collect()}
    near = {(i, j) for i in unit for j in unit if i != j and unit[i] @ unit[j] > workload.NEAR}
    assert found == near - rated and near & rated


def test_checks_of_neighbours_neither_store_nor_shuffle_pairs(spark, tables, monkeypatch):
    stored = []
    monkeypatch.setattr(workload, "staged", lambda df, name: stored.append(name) or df)
    found = workload.als_similar_checks(spark, tables)
    assert found.first().asDict() == {
        "unknown_items": 0, "self_pairs": 0, "not_above": 0, "one_way": 0, "off_score": 0, "items": 30}
    # The plan of the pairs; that of the number of items is a subquery, not a child.
    assert stored == [] and "Join" not in names(found._jdf.queryExecution().optimizedPlan())


def test_checks_of_folded_users_join_the_ratings_once_and_shuffle_no_component(spark, tables):
    found = workload.als_fold_in_checks(spark, tables)
    row = found.first()
    assert row["users"] > 0 and row["entries"] == 10 * row["users"] and row["off_equations"] == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "l_quantity" not in plan
    assert not re.search(r"hashpartitioning\(uid#\d+, at#", plan)


def test_predictions_work_the_ratings_out_once(spark, tables, monkeypatch):
    """The fit, the predictions and their checks read stored ratings, not the join of the tables."""
    trained, fit = [], model.fit_als
    monkeypatch.setattr(model, "fit_als", lambda train: trained.append(train) or fit(train))
    ratings = workload.views.ratings(spark, tables)
    train, test = model.split_ratings_by_key(ratings)
    found = workload.als_predict(spark, tables)
    columns = ["uid", "mid", "score"]
    known = test.join(train, "uid", "left_semi").join(train, "mid", "left_semi").select(columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, known.collect()))
    row = workload.als_predict_checks(spark, tables).first().asDict()
    assert row == {"kept": known.count(), "off_product": 0, "cold": test.count() + 2 - known.count()}
    for rows in (found, *trained):
        assert not [f for f in rows.inputFiles() if f.rsplit("/", 2)[1] in ("orders.parquet", "lineitem.parquet")]
    for rows in trained:
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, train.collect()))
    assert len(trained) == 2


def test_a_long_fit_drops_the_shuffles_of_past_iterations(spark, tables):
    """The solver drops shuffles where it stores vectors; the model stays the same."""
    ratings = workload.views.ratings(spark, tables)
    solver = model._als(3, 6, 0.1, 42, 4)
    assert solver.getCheckpointInterval() == model.KEPT_ITERATIONS <= 2
    model.fit_als(ratings)  # names the shared folder, without which nothing is dropped
    data = model.complete_ratings(ratings)
    often, once = (s.fit(data) for s in (solver, solver.copy().setCheckpointInterval(10)))
    for side in ("userFactors", "itemFactors"):
        a, b = ({r["id"]: r["features"] for r in getattr(m, side).collect()} for m in (often, once))
        assert a.keys() == b.keys() and len(a)
        assert all(np.allclose(a[i], b[i], atol=1e-4) for i in a)


def test_many_ratings_make_more_item_blocks_and_the_same_model(spark, tables, monkeypatch):
    """A block's task holds its ratings: more ratings are more item blocks, on the executors'
    disks. User blocks stay, since the solver starts from their vectors."""
    ratings = workload.views.ratings(spark, tables)
    assert model.item_blocks_for(ratings) == model.BLOCKS
    usual = model.fit_als(ratings, rank=3, max_iter=4, reg=0.1)
    fits, als = [], model._als
    monkeypatch.setattr(model, "_als", lambda *a: fits.append(als(*a)) or fits[-1])
    monkeypatch.setattr(model, "BLOCK_RATINGS", 50)
    more = model.fit_als(ratings, rank=3, max_iter=4, reg=0.1)
    model.fit_als(ratings, rank=3, max_iter=1, blocks=4)
    assert [(f.getNumUserBlocks(), f.getNumItemBlocks()) for f in fits] == [(model.BLOCKS, 24), (4, 4)]
    assert {f.getIntermediateStorageLevel() for f in fits} == {"DISK_ONLY"}
    for side in ("userFactors", "itemFactors"):
        a, b = ({r["id"]: r["features"] for r in getattr(m, side).collect()} for m in (usual, more))
        assert a.keys() == b.keys() and len(a)
        assert all(np.allclose(a[i], b[i], atol=1e-4) for i in a)


def test_the_parts_of_a_search_are_columns_worked_out_once(spark, tables):
    drawn = model._drawn(workload.views.ratings(spark, tables), seed=5)
    assert len(drawn.inputFiles()) > 0
    first, again = (sorted(tuple(r) for r in drawn.collect()) for _ in range(2))
    assert first == again and len(first) == 1200
    assert 0 < drawn.where("is_train").count() < 1200
