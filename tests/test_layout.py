import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import lookup, popularity
from tastegrid.operators.similarity import similar_items
from tastegrid.plans import jobs, views
from tastegrid.session import fresh_path
from tastegrid.sources import layout, tables
from tastegrid.streaming import realtime
from tests.plans import files_read

SF = "/root/testdata/sf0.001"
RATINGS = "uid int, mid int, score double"
PARTS = 12


@pytest.fixture(scope="module")
def ratings(spark):
    path = fresh_path(spark, "ratings")
    layout.write_laid_out(views.ratings(spark, SF), path, "uid", PARTS)
    return spark.read.parquet(path)


def read_of(df, word="ratings"):
    rows, found = files_read(df)
    return rows, sum(n for place, n in found.items() if word in place)


def test_a_laid_out_table_holds_the_same_rows(spark, ratings):
    assert layout.layout_of(ratings) == ("uid", PARTS) and layout.layout_of(layout.plain(ratings)) is None
    source = views.ratings(spark, SF)
    assert layout.plain(ratings).exceptAll(source).count() == 0 and ratings.count() == source.count()
    assert layout.layout_of(source.withColumn("other_in_3", F.lit(1))) is None


def test_a_lookup_reads_the_parts_of_its_keys(spark, ratings):
    all_files = len(ratings.inputFiles())
    source = views.ratings(spark, SF)
    uids = [r["uid"] for r in source.select("uid").distinct().orderBy("uid").limit(2).collect()]
    for got, want in (
        (layout.rows_with(ratings, "uid", uids[:1]), source.where(F.col("uid") == uids[0])),
        (layout.rows_with(ratings, "uid", [*uids, None, uids[0]]), source.where(F.col("uid").isin(uids))),
        (layout.rows_of(ratings, "uid", spark.createDataFrame([(uids[0],), (uids[0],)], "uid long"), 2),
         source.where(F.col("uid") == uids[0])),
    ):
        rows, files = read_of(got)
        assert sorted(rows) == sorted(want.collect()) and 0 < files <= max(3, all_files // 3)
    assert read_of(layout.rows_with(ratings, "uid", []))[0] == []
    assert layout.rows_of(ratings, "uid", spark.createDataFrame([], "uid int"), 0).collect() == []
    nobody = spark.createDataFrame([(None,), (-5,)], "uid int")
    assert layout.rows_of(ratings, "uid", nobody).collect() == []


def test_files_have_a_bloom_filter_and_sorted_keys(spark, ratings):
    for name in ratings.inputFiles()[:3]:
        keys = pq.read_table(name.removeprefix("file://"), columns=["uid"])["uid"].to_pylist()
        assert keys == sorted(keys)
        column = pq.ParquetFile(name.removeprefix("file://")).metadata.row_group(0).column(0)
        assert column.path_in_schema == "uid"
    path = fresh_path(spark, "bloom")
    spark.range(0, 40_000, 2).repartition(1).write.options(**layout.bloom_options("id")).parquet(path)
    with_filter = spark.read.parquet(path)
    sizes = [open(f.removeprefix("file://"), "rb").seek(0, 2) for f in with_filter.inputFiles()]
    path = fresh_path(spark, "no-bloom")
    spark.range(0, 40_000, 2).repartition(1).write.parquet(path)
    plain = [open(f.removeprefix("file://"), "rb").seek(0, 2) for f in spark.read.parquet(path).inputFiles()]
    assert sum(sizes) > sum(plain)


def test_a_hot_key_is_written_by_several_tasks(spark):
    rows = spark.range(0, 60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("uid"), F.col("id").alias("mid"))
    path = fresh_path(spark, "hot")
    layout.write_laid_out(rows, path, "uid", 4, tasks=12)
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows for f in spark.read.parquet(path).inputFiles()]
    assert sum(sizes) == 60_000 and max(sizes) < 15_000


def test_lookups_by_name_id_and_item(spark):
    users, movies = views.users(spark, SF), views.movies(spark, SF)
    paths = [fresh_path(spark, n) for n in ("users", "movies", "titles", "by-item")]
    layout.write_laid_out(users, paths[0], "username", PARTS)
    layout.write_laid_out(movies, paths[1], "id", PARTS)
    layout.write_laid_out(movies, paths[2], "movie_name", PARTS)
    layout.write_laid_out(views.ratings(spark, SF), paths[3], "mid", PARTS)
    laid = [spark.read.parquet(p) for p in paths]
    names = ["Customer#000000003", "nobody"]
    title = movies.first()["movie_name"]
    for got, want, word in (
        (lookup.resolve_users(laid[0], names), lookup.resolve_users(users, names), "users"),
        (lookup.movie_names(laid[1], [5]), lookup.movie_names(movies, [5]), "movies"),
        (lookup.get_by_id(laid[1], "5"), lookup.get_by_id(movies, "5"), "movies"),
        (lookup.get_by_id(laid[1], 5), lookup.get_by_id(movies, 5), "movies"),
        (lookup.get_by_id(laid[1], "x"), lookup.get_by_id(movies, "x"), "movies"),
        (lookup.search_movies(laid[2], title), lookup.search_movies(movies, title), "titles"),
        (popularity.rating_histogram(laid[3], 5), popularity.rating_histogram(views.ratings(spark, SF), 5), "by-item"),
    ):
        rows, files = read_of(got, word)
        assert got.columns == want.columns and sorted(rows) == sorted(want.collect())
        assert files <= 4 < len(laid[0].inputFiles())
    asked = users.select(F.col("id").cast("string").alias("record_id"))
    assert lookup.get_by_id(laid[1], asked).columns == ["id", "record_id", "movie_name"]


def test_a_micro_batch_reads_the_parts_it_asks_for(spark, ratings):
    lists = similar_items(views.factors(spark, SF), 0.2)
    path = fresh_path(spark, "lists")
    layout.write_laid_out(lists, path, "mid", PARTS)
    laid = spark.read.parquet(path)
    asked = spark.createDataFrame([(1, 3, 5.0), (1, 3, 4.0)], RATINGS)
    hot = popularity.hot_items(views.ratings(spark, SF))
    got = realtime.realtime_recs(asked, laid, hot, bound=2)
    rows, files = read_of(got, "lists")
    assert sorted(rows) == sorted(realtime.realtime_recs(asked, lists, hot).collect())
    assert 0 < files <= 2

    answers = {}
    for name, neighbours, rated in (("laid", laid, ratings), ("plain", lists, views.ratings(spark, SF))):
        out = fresh_path(spark, "out")
        static = realtime.Tables(lambda: neighbours, lambda: hot, realtime.batch_folder_sink(out),
                                 ratings=lambda: rated)
        realtime.realtime_batch(spark.createDataFrame([("1,3,5",), ("2,4,1",), ("x",)], "value string"), 0, static)
        answers[name] = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert answers["laid"] == answers["plain"] and len(answers["laid"]) == 2


def test_stored_tables_with_a_layout(spark):
    root, csv = fresh_path(spark, "tables"), fresh_path(spark, "csv")
    source = views.ratings(spark, SF)
    source.write.csv(csv, header=True)
    loaded = jobs.load(spark, csv, root, parts=PARTS)
    assert loaded.columns == source.columns and loaded.exceptAll(source).count() == 0
    users = views.users(spark, SF)
    asked = spark.createDataFrame([("Customer#000000001", 5, 4.0)], "username string, mid int, score double")
    before = source.where("uid = 1").count()
    jobs.ingest(spark, asked, users)
    stored = tables.read_table(spark, jobs.RATINGS, with_layout=True)
    assert layout.layout_of(stored) == ("uid", PARTS) and stored.count() == source.count() + 1
    rows, found = files_read(layout.rows_with(stored, "uid", [1]))
    assert len(rows) == before + 1 and sum(found.values()) <= 4
    jobs.offline(spark, root, rank=4, max_iter=2, threshold=0.2, parts=PARTS)
    lists = tables.read_table(spark, jobs.MOVIE_RECS, with_layout=True)
    assert layout.layout_of(lists) == ("mid", PARTS)


def test_lists_dealt_by_part_are_written_as_they_come(spark, monkeypatch):
    """Each task of the lists has one part's, in order: no shuffle and no sort before the files."""
    factors = views.factors(spark, SF)
    lists, path = similar_items(factors, 0.2, groups=5, parts=4), fresh_path(spark, "lists")
    monkeypatch.setattr(layout, "laid_out", None)  # what shuffles and sorts the rows
    layout.write_laid_out(lists, path, "mid", 4, dealt=True)
    assert spark.conf.get(layout._WRITERS, None) in (None, "0")  # as before
    laid = spark.read.parquet(path)
    assert layout.layout_of(laid) == ("mid", 4)
    rows = laid.withColumn("file", F.input_file_name()).select("mid", "mid_in_4", "file").collect()
    assert all(r["mid_in_4"] == n for r, n in zip(rows, [r[0] for r in laid.select(layout.part_of("mid", 4)).collect()]))
    for name in laid.inputFiles():
        mids = pq.read_table(name.removeprefix("file://"), columns=["mid"])["mid"].to_pylist()
        assert mids == sorted(mids)
    assert len(laid.inputFiles()) <= 8
    assert sorted(layout.plain(laid).collect()) == sorted(similar_items(factors, 0.2).collect())


def test_many_messages_about_few_items_shuffle_no_list(spark):
    """The items that a large batch asks for are stored, so that Spark sends them to the lists."""
    lists = spark.range(50).select(
        F.col("id").cast("int").alias("mid"), F.lit(0).alias("start"),
        F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.struct(
            i.cast("int").alias("mid"), (1 / i).alias("score"))).alias("recs"))
    asked = spark.range(20_000).select((F.col("id") % 7).cast("int").alias("mid"))
    found = layout.rows_of(lists, "mid", asked, 20_000)
    rows = found.select("mid").collect()
    assert sorted(r["mid"] for r in rows) == list(range(7))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
