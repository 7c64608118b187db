"""Counts kept up to date by loads and ingests."""

from pyspark.sql import functions as F

from tastegrid.operators import popularity
from tastegrid.plans import jobs, views
from tastegrid.session import fresh_path
from tastegrid.sources import counts, tables
from tests.plans import files_read

SF = "/root/testdata/sf0.001"
RATINGS = "uid int, mid int, score double"
REQUESTS = "username string, mid int, score double"


def rows(df):
    return sorted(tuple(r) for r in df.select("mid", "score", "n", "place").collect())


def test_popular_items_after_three_ingests_and_a_reload(spark, frame):
    root, csv, path = (fresh_path(spark, n) for n in ("tables", "csv", "counts"))
    views.ratings(spark, SF).write.csv(csv, header=True)
    users = views.users(spark, SF)
    jobs.load(spark, csv, root, counts=path, parts=4)

    def same():
        jobs.refresh_hot(spark, path, root)
        stored = tables.read_table(spark, jobs.RATINGS)
        assert rows(tables.read_table(spark, jobs.HOT)) == rows(popularity.popular_places(stored))

    same()
    for i in range(3):
        asked = [(f"Customer#{u:09d}", m, 4.0) for u in range(1, 40) for m in (7 + i, 900 + u % 3)]
        jobs.ingest(spark, frame([*asked, ("nobody", 7, 1.0)], REQUESTS), users, counts=path, ingest_id=f"i{i}")
        same()
    version = tables.current_version(spark, jobs.RATINGS)
    assert counts.parts_of(spark, path, version) == ["i0", "i1", "i2", "load"]
    _, read = files_read(counts.counts_of(spark, path, version))
    assert read and all("counts" in place for place in read)
    jobs.load(spark, csv, root, counts=path)
    same()


def test_sketches_of_parts_estimate_all_raters(spark):
    ratings = spark.range(0, 120_000).select(
        (F.col("id") * 7919 % 30_011).cast("int").alias("uid"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).cast("int").alias("mid"),
        F.lit(1.0).alias("score"))
    path = fresh_path(spark, "counts")
    for part in range(3):
        counts.add_part(ratings.where(f"uid % 3 = {part}"), path, "v", str(part))
        counts.add_part(ratings.where(f"uid % 3 = {part}"), path, "v", str(part))
    got = {r["mid"]: (r["n"], r["raters"]) for r in counts.counts_of(spark, path, "v").collect()}
    exact = popularity.rating_counts(ratings, distinct_users=True).collect()
    n = {r["mid"]: r["n"] for r in popularity.rating_counts(ratings).collect()}
    assert {m: c for m, (c, _) in got.items()} == n
    # Three standard errors of a sketch of this size.
    assert all(abs(got[r["mid"]][1] - r["n"]) <= 3 * counts.ERROR * r["n"] + 1 for r in exact)
    by_raters = counts.places_of(counts.counts_of(spark, path, "v"), by_raters=True)
    assert by_raters.where("place = 1").first()["mid"] == 1


def test_no_parts_null_items_and_null_users(spark, frame):
    path = fresh_path(spark, "counts")
    assert counts.counts_of(spark, path, "v").count() == 0
    counts.add_part(frame([(None, 1, 1.0), (2, None, 1.0), (2, 1, 1.0), (2, 1, 2.0)], RATINGS), path, "v", "a")
    assert [tuple(r) for r in counts.counts_of(spark, path, "v").collect()] == [(1, 3, 1)]
    counts.add_part(frame([], RATINGS), path, "w", "a")
    assert counts.counts_of(spark, path, "w").count() == 0
