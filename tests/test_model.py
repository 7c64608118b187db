import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import model
from tastegrid.plans import views

SF = "/root/testdata/sf0.001"
RATINGS = "uid int, mid int, score double"


@pytest.fixture(scope="module")
def ratings(spark):
    return views.ratings(spark, SF).cache()


@pytest.fixture(scope="module")
def fitted(ratings):
    return model.fit_als(ratings, rank=8, max_iter=5)


def test_incomplete_rows_are_left_out_and_counted(frame):
    rows = frame([(None, 1, 3.0), (1, 1, None), (1, None, 2.0), (None, None, None), (1, 1, 3.0)],
                 RATINGS)
    assert model.complete_ratings(rows).count() == 1
    assert tuple(model.dropped_ratings(rows).first()) == (5, 2, 2, 2, 4)


def test_fit_takes_incomplete_ratings(frame):
    rows = [(u, i, float(1 + (u + i) % 5)) for u in range(6) for i in range(5)]
    fitted = model.fit_als(frame([*rows, (None, 1, 3.0), (1, 1, None)], RATINGS), 2, 2)
    assert fitted.rank == 2 and model.item_factors(fitted).count() == 5


def test_repeated_ratings_can_count_once(frame):
    rows = frame([(1, 2, 1.0), (1, 2, 4.0), (1, 3, 5.0)], RATINGS)
    assert sorted(tuple(r) for r in model.mean_per_pair(rows).collect()) == [
        (1, 2, 2.5), (1, 3, 5.0)]


def test_prediction_is_the_inner_product(fitted, ratings):
    u = {r["id"]: np.array(r["features"]) for r in model.user_factors(fitted).collect()}
    i = {r["id"]: np.array(r["features"]) for r in model.item_factors(fitted).collect()}
    for r in model.predict(fitted, ratings).limit(200).collect():
        assert r["prediction"] == pytest.approx(float(u[r["uid"]] @ i[r["mid"]]), abs=1e-4)


def test_unseen_user_or_item_drops_out(fitted, frame):
    asked = frame([(0, 0), (10_000, 0), (0, 10_000)], "uid int, mid int")
    assert [r["uid"] for r in model.predict(fitted, asked).collect()] == [0]


def test_lists_agree_with_the_librarys_own(fitted):
    ours = {r["uid"]: [x["score"] for x in r["recs"]]
            for r in model.user_topn(fitted, 10).collect()}
    theirs = {r["uid"]: [x["rating"] for x in r["recommendations"]]
              for r in fitted.recommendForAllUsers(10).collect()}
    assert ours.keys() == theirs.keys()
    for uid, scores in ours.items():
        assert scores == pytest.approx(theirs[uid], abs=1e-4)
        assert scores == sorted(scores, reverse=True) and len(scores) == 10


def test_no_rated_item_is_left(fitted, ratings):
    flat = model.user_topn(fitted, 10, exclude_seen=ratings).select(
        "uid", F.explode("recs.mid").alias("mid"))
    assert flat.count() == 10 * ratings.select("uid").distinct().count()
    assert flat.join(ratings, ["uid", "mid"], "left_semi").count() == 0


def test_same_seed_same_error(ratings):
    train, test = model.split_ratings_by_key(ratings)
    errors = [
        model.rmse(model.predict(model.fit_als(train, 4, 3, blocks=4), test)).first()["rmse"]
        for _ in range(2)
    ]
    assert errors[0] == pytest.approx(errors[1], abs=1e-6)


def test_splits_are_whole_and_apart(ratings):
    for parts in (model.split_ratings_by_key(ratings), model.split_ratings(ratings, seed=7)):
        train, test = parts
        assert train.count() + test.count() == ratings.count()
        assert 0.7 < train.count() / ratings.count() < 0.9
        together = train.unionAll(test)
        assert together.exceptAll(ratings).count() == 0
    train, test = model.split_ratings_by_key(ratings)
    assert train.join(test, ["uid", "mid"], "left_semi").count() == 0


def test_rmse(frame):
    scored = frame([(1.0, 2.0, "a"), (3.0, 3.0, "a"), (5.0, 2.0, "b")],
                   "score double, prediction double, g string")
    assert model.rmse(scored).first()[0] == pytest.approx((10 / 3) ** 0.5)
    assert {r["g"]: r["rmse"] for r in model.rmse(scored, by=["g"]).collect()} == {
        "a": pytest.approx(0.5 ** 0.5), "b": 3.0}


def test_rmse_agrees_with_the_librarys_evaluator(fitted, ratings):
    from pyspark.ml.evaluation import RegressionEvaluator

    scored = model.predict(fitted, ratings)
    theirs = RegressionEvaluator(metricName="rmse", labelCol="score").evaluate(scored)
    assert model.rmse(scored).first()["rmse"] == pytest.approx(theirs)


def test_best_params(frame):
    results = frame([(10, 0.1, 0.9), (20, 0.01, 0.4), (10, 0.01, 0.4), (30, 0.1, float("nan")),
                     (30, 0.2, None)], "rank int, reg double, rmse double")
    assert tuple(model.best_params(results).first()) == (10, 0.01, 0.4)


def test_grid_search_fits_every_point(ratings):
    results = model.grid_search(ratings, ranks=(2, 4), regs=(0.01, 0.1), max_iter=2)
    rows = results.collect()
    assert sorted((r["rank"], r["reg"]) for r in rows) == [
        (2, 0.01), (2, 0.1), (4, 0.01), (4, 0.1)]
    assert all(0 < r["rmse"] < 10 for r in rows)
    best = model.best_params(results).first()
    assert best["rmse"] == min(r["rmse"] for r in rows)


def test_model_neighbours(fitted):
    items = model.model_similar_items(fitted, threshold=0.7)
    v = {r["id"]: np.array(r["features"], dtype=float)
         for r in model.item_factors(fitted).collect()}
    rows = items.collect()
    assert rows
    for row in rows[:50]:
        for rec in row["recs"]:
            a, b = v[row["mid"]], v[rec["mid"]]
            cosine = a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
            assert rec["score"] == pytest.approx(cosine, abs=1e-6) and rec["score"] > 0.7


def test_a_search_by_rungs_finds_the_point_of_the_whole_grid(ratings, monkeypatch):
    fits = []
    als = model._als
    monkeypatch.setattr(model, "_als", lambda rank, max_iter, *a: fits.append(max_iter) or als(rank, max_iter, *a))
    ranks, regs = (2, 4, 8), (0.01, 0.1, 0.5)
    rows = model.rung_search(ratings, ranks, regs, rungs=(2, 3, 8), parallelism=1)
    spent = sum(fits)
    assert fits == [2] * 9 + [3] * 3 + [8] and spent < 9 * 8 / 2
    last = rows.where("iterations = 8")
    assert rows.groupBy("iterations").count().orderBy("iterations").collect()[0]["count"] == 9
    whole = model.grid_search(ratings, ranks, regs, max_iter=8)
    assert model.best_params(last).first() == model.best_params(whole).first()


def test_a_search_by_rungs_goes_on_with_one_point_and_without_errors(frame):
    rows = frame([(1, 2, 1.0), (1, 3, 4.0), (2, 2, 5.0)], RATINGS)
    found = model.rung_search(rows, (2,), (0.1,), rungs=(1, 2), parallelism=2).collect()
    assert [(r["iterations"], r["rank"], r["reg"]) for r in found] == [(1, 2, 0.1), (2, 2, 0.1)]
