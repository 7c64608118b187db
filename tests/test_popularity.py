from tastegrid.operators import popularity as pop

RATINGS = "uid int, mid int, score double"


def times(mid, n, start=0):
    return [(start + i, mid, 3.0) for i in range(n)]


def test_tie_at_the_cut_goes_to_the_smaller_id(frame):
    ratings = frame(times(8, 2) + times(7, 2) + times(1, 3), RATINGS)
    assert [tuple(r) for r in pop.hot_items(ratings, k=2).collect()] == [(1, 5.0, 3), (7, 5.0, 2)]


def test_rows_count_or_users_count(frame):
    ratings = frame([(1, 10, 4.0), (1, 10, 4.0), (2, 20, 1.0)], RATINGS)
    rows = {r["mid"]: r["n"] for r in pop.rating_counts(ratings).collect()}
    users = {r["mid"]: r["n"] for r in pop.rating_counts(ratings, True).collect()}
    assert rows == {10: 2, 20: 1} and users == {10: 1, 20: 1}


def test_null_item_is_not_popular(frame):
    ratings = frame([(1, None, 4.0), (2, None, 4.0), (3, 5, 1.0)], RATINGS)
    assert [r["mid"] for r in pop.hot_items(ratings).collect()] == [5]


def test_hot_list_keeps_order(spark, frame):
    ratings = frame(times(3, 1) + times(9, 4) + times(4, 2), RATINGS)
    hot = pop.hot_list(pop.popular_places(ratings), 5)
    assert spark.range(1).select(hot.alias("h")).first()["h"] == [9, 4, 3]


def test_places_over_many_partitions(spark):
    counted = spark.range(500).selectExpr("CAST(id AS INT) AS mid", "id % 7 AS n").repartition(9)
    got = {r["mid"]: r["place"] for r in pop.places(counted).collect()}
    order = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert got == {mid: place + 1 for place, mid in enumerate(order)}


def test_popular_names_after_the_cut(frame):
    ratings = frame(times(1, 5) + times(2, 4) + times(3, 3), RATINGS)
    movies = frame([(1, "one"), (3, "three")], "id int, movie_name string")
    got = [tuple(r) for r in pop.popular_movies(ratings, movies, k=2).collect()]
    assert got == [(1, "one", 5)]


def test_histogram_gaps_and_extra_score(frame):
    ratings = frame([(1, 1, 5.0), (2, 1, 5.0), (3, 1, 2.0), (4, 1, 3.5), (5, 2, 1.0)], RATINGS)
    got = {r["score"]: r["n"] for r in pop.rating_histogram(ratings, 1).collect()}
    assert got == {1.0: 0, 2.0: 1, 3.0: 0, 3.5: 1, 4.0: 0, 5.0: 2}


def test_histogram_of_an_unrated_item_is_all_zero(frame):
    got = pop.rating_histogram(frame([], RATINGS), 9).collect()
    assert sorted((r["score"], r["n"]) for r in got) == [(float(s), 0) for s in range(1, 6)]


def test_all_histograms_agree_with_single_ones(frame):
    ratings = frame([(1, 1, 5.0), (2, 1, 3.5), (3, 2, 1.0), (4, 2, 1.0)], RATINGS)
    every = pop.rating_histograms_all(ratings).collect()
    for mid in (1, 2):
        single = {(r["score"], r["n"]) for r in pop.rating_histogram(ratings, mid).collect()}
        assert {(r["score"], r["n"]) for r in every if r["mid"] == mid} == single
