"""The stream that keeps what users have rated as its state."""

import pytest

from tastegrid.operators import popularity
from tastegrid.operators.similarity import similar_items
from tastegrid.plans import views
from tastegrid.session import fresh_path
from tastegrid.sources import streams
from tastegrid.streaming import realtime
from tastegrid.streaming.messages import parse_rating_messages

SF = "/root/testdata/sf0.001"
RATINGS = "uid int, mid int, score double"


@pytest.fixture(scope="module")
def static_tables(spark):
    lists = similar_items(views.factors(spark, SF), 0.2).cache()
    hot = popularity.popular_places(views.ratings(spark, SF)).cache()
    return lists, hot


class Stream:
    """A stream over lines sent to a folder; each run answers what has come since."""

    def __init__(self, spark, lists, hot, ratings, **options):
        self.spark, self.path, self.out = spark, fresh_path(spark, "inbox"), fresh_path(spark, "out")
        self.options, self.reads = options, []

        def rated():
            self.reads.append(1)
            return ratings
        self.static = realtime.Tables(
            lambda: lists, lambda: hot, realtime.batch_folder_sink(f"{self.out}/recs"),
            realtime.batch_folder_sink(f"{self.out}/rejects"), rated)

    def send(self, *lines):
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode(
            "append").text(self.path)

    def run(self):
        source = streams.rating_stream(self.spark.readStream.text(self.path))
        before = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", "2")
        try:
            realtime.start_keyed(
                source, self.static, f"{self.out}/cp", {"availableNow": True}, **self.options
            ).awaitTermination()
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", before)

    def answers(self, kind="recs"):
        rows = self.spark.read.parquet(f"{self.out}/{kind}").collect()
        return sorted(tuple(r) for r in rows)


def expected(spark, lists, hot, ratings, lines, batch_id):
    good, _ = parse_rating_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = realtime.realtime_recs(good, lists, hot, seen=ratings).collect()
    return [(*r, batch_id) for r in map(tuple, rows)]


FIRST = ["1,3,5", "1,3,4", "2,4,1", "bad", "7,9", '"3","5","2.5"', "99999,3,1", "1,777777,5"]
SECOND = ["1,3,5", "2,8,3", "99999,3,2"]


@pytest.mark.parametrize("blocks, remember", [(1, True), (3, True), (1, False)])
def test_answers_equal_those_from_the_stored_ratings(spark, static_tables, blocks, remember):
    lists, hot = static_tables
    ratings = views.ratings(spark, SF).cache()
    stream = Stream(spark, lists, hot, ratings, blocks=blocks, remember=remember)
    stream.send(*FIRST)
    stream.run()
    want = expected(spark, lists, hot, ratings, FIRST, 0)
    assert stream.answers() == sorted(want) and len(stream.answers("rejects")) == 2

    # A restart goes on with the state, and what came in the first batch counts as rated.
    stream.send(*SECOND)
    stream.run()
    brought = [(1, 3, 5.0), (2, 4, 1.0), (3, 5, 2.5), (99999, 3, 1.0), (1, 777777, 5.0)]
    known = ratings.union(spark.createDataFrame(brought if remember else [], RATINGS))
    assert stream.answers() == sorted(want + expected(spark, lists, hot, known, SECOND, 1))


def test_no_batch_reads_the_stored_ratings(spark, static_tables):
    """The stored ratings change after the start; the state doesn't follow them."""
    lists, hot = static_tables
    path = fresh_path(spark, "ratings")
    views.ratings(spark, SF).write.parquet(path)
    ratings = views.ratings(spark, SF).cache()
    stream = Stream(spark, lists, hot, spark.read.schema(RATINGS).parquet(path), remember=False)
    stream.send(*FIRST)
    stream.run()
    rows = [(1, r["mid"], 5.0) for r in views.movies(spark, SF).selectExpr("id AS mid").collect()]
    spark.createDataFrame(rows, RATINGS).write.mode("append").parquet(path)
    stream.send(*SECOND)
    stream.run()
    want = expected(spark, lists, hot, ratings, FIRST, 0) + expected(spark, lists, hot, ratings, SECOND, 1)
    assert stream.answers() == sorted(want)


def test_a_failed_batch_is_repeated_with_the_state_before_it(spark, static_tables):
    lists, hot = static_tables
    ratings = views.ratings(spark, SF).cache()
    stream = Stream(spark, lists, hot, ratings)
    stream.send(*FIRST)
    stream.run()
    sink, calls = stream.static.sink, []

    def failing(df, batch_id):
        sink(df, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost")
    stream.static.sink = failing
    stream.send(*SECOND)
    with pytest.raises(Exception, match="lost"):
        stream.run()
    stream.run()
    brought = [(1, 3, 5.0), (2, 4, 1.0), (3, 5, 2.5), (99999, 3, 1.0), (1, 777777, 5.0)]
    known = ratings.union(spark.createDataFrame(brought, RATINGS))
    want = expected(spark, lists, hot, ratings, FIRST, 0) + expected(spark, lists, hot, known, SECOND, 1)
    assert calls == [1, 1] and stream.answers() == sorted(want)


def test_a_stream_without_stored_ratings_learns_from_its_messages(spark, static_tables):
    lists, hot = static_tables
    stream = Stream(spark, lists, hot, None)
    stream.static.ratings = None
    item = lists.first()
    stream.send(f"5,{item['mid']},5")
    stream.run()
    first = stream.answers()[0][3].split(",")
    stream.send(f"5,{first[0]},5", "bad")
    stream.run()
    stream.send(f"5,{item['mid']},5")
    stream.run()
    again = [r for r in stream.answers() if r[4] == 2][0][3].split(",")
    assert first[0] not in again
