"""Served answers as a log with compaction."""

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import popularity
from tastegrid.session import fresh_path
from tastegrid.sources import files, streams
from tastegrid.streaming import realtime
from tastegrid.streaming.served import ServedLog
from tests.plans import files_read

ANSWERS = "uid int, mid int, score double, recs string, batch_id long"


@pytest.fixture
def put(frame):
    def write(log, batch_id, rows):
        log.sink(frame([(*row[:2], 5.0, row[2], batch_id) for row in rows], ANSWERS), batch_id)
    return write


def answers(df):
    found = [(r["uid"], r["mid"], r["recs"]) for r in df.collect()]
    assert len({r[:2] for r in found}) == len(found)
    return sorted(found)


def test_runs_tables_and_lookups(spark, frame, put):
    path = fresh_path(spark, "served")
    log = ServedLog(spark, path, query=1, parts=8)
    assert answers(log.read()) == [] and log.compact() is None
    put(log, 0, [(1, 1, "a"), (2, 1, "b"), (1, 1, "a")])
    put(log, 1, [(1, 1, "c"), (3, 1, None)])
    put(log, 1, [(1, 1, "another try"), (9, 9, "x")])
    want = [(1, 1, "c"), (2, 1, "b"), (3, 1, None)]
    assert answers(log.read()) == want and len(log.waiting()) == 2
    log.compact()
    assert answers(log.read()) == want and log.waiting() == [] and log.compact() is None
    put(log, 0, [(1, 1, "replayed after the merge")])
    assert answers(log.read()) == want
    put(log, 2, [(2, 1, "d"), (4, 4, "e")])
    asked = frame([(2, 1), (3, 1), (2, 1), (5, 5)], "uid int, mid int")
    assert answers(log.lookup(asked, 4)) == [(2, 1, "d"), (3, 1, None)]


def test_a_new_checkpoint_loses_and_repeats_nothing(spark, put):
    path = fresh_path(spark, "served")
    numbers = [ServedLog.number_of(spark, path, cp) for cp in ("/cp/a", "/cp/b", "/cp/a/", "/cp/b")]
    assert numbers == [1, 2, 1, 2]
    first, second = (ServedLog(spark, path, n, 4) for n in (1, 2))
    put(first, 0, [(1, 1, "old"), (2, 2, "kept")])
    put(first, 7, [(1, 1, "older batch number, newer")])
    first.compact()
    put(second, 0, [(1, 1, "new")])
    want = [(1, 1, "new"), (2, 2, "kept")]
    assert answers(second.read()) == want
    second.compact()
    assert answers(first.read()) == want


def test_old_tables_and_runs_go(spark, put):
    log = ServedLog(spark, fresh_path(spark, "served"), 1, 2)
    for batch in range(4):
        put(log, batch, [(batch, 0, str(batch)), (9, 9, str(batch))])
        log.compact()
        log.clean()
        want = [(b, 0, str(b)) for b in range(batch + 1)] + [(9, 9, str(batch))]
        assert answers(log.read()) == want
    assert len(log.tables()) == 2 and len(files.folders(spark, f"{log.path}/runs")) == 1


def test_a_compaction_that_fails_changes_nothing(spark, put, monkeypatch):
    log = ServedLog(spark, fresh_path(spark, "served"), 1, 2)
    put(log, 0, [(1, 1, "a")])
    with monkeypatch.context() as broken:
        broken.setattr(files, "rename", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            log.compact()
    assert log.waiting() == ["000001-000000000000"] and answers(log.read()) == [(1, 1, "a")]
    log.compact()
    assert log.waiting() == [] and answers(log.read()) == [(1, 1, "a")]


def test_a_lookup_reads_the_parts_of_its_users(spark, frame, put):
    log = ServedLog(spark, fresh_path(spark, "served"), 1, 16)
    put(log, 0, [(u, 1, str(u)) for u in range(200)])
    log.compact()
    rows, found = files_read(log.lookup(frame([(3, 1)], "uid int, mid int"), 1))
    assert [r["recs"] for r in rows] == ["3"]
    assert sum(n for place, n in found.items() if "tables" in place) <= 2


def test_a_stream_into_the_log(spark, frame):
    path, inbox = fresh_path(spark, "served"), fresh_path(spark, "inbox")
    lists = frame([(10, 0, [(21, 0.9)])], "mid int, start int, recs array<struct<mid:int,score:double>>")
    hot = popularity.hot_items(frame([(1, 5, 3.0)], "uid int, mid int, score double"))

    def run(checkpoint):
        log = ServedLog(spark, path, ServedLog.number_of(spark, path, checkpoint), 4)
        source = streams.rating_stream(spark.readStream.text(inbox))
        realtime.start_realtime(
            source, realtime.Tables(lambda: lists, lambda: hot, log.sink), checkpoint, {"availableNow": True}
        ).awaitTermination()
        return answers(log.read())

    for line, checkpoint, want in (
        ("1,10,5", "a", [(1, 10, "21")]), ("2,99,1", "a", [(1, 10, "21"), (2, 99, "5")]),
        ("3,10,1", "b", [(1, 10, "21"), (2, 99, "5"), (3, 10, "21")]),
    ):
        frame([(line,)], "value string").coalesce(1).write.mode("append").text(inbox)
        assert run(f"{path}/cp/{checkpoint}") == want


def test_many_batches_are_put_in_one_job_as_the_same_runs(spark):
    rows = [(u, u % 3, f"{u},{b}", b) for b in range(12) for u in range(5)]
    answers = spark.createDataFrame([*rows, *rows[:3]], "uid int, mid int, recs string, batch_id long")
    one, all_at_once = (ServedLog(spark, fresh_path(spark, "served"), query=1, parts=2) for _ in range(2))
    for batch in range(12):
        one.sink(answers.where(F.col("batch_id") == batch), batch)
    all_at_once.sink(answers.where("batch_id = 3").withColumn("recs", F.lit("first")), 3)
    all_at_once.sink_all(answers)
    runs = one.waiting()
    assert all_at_once.waiting() == runs and len(runs) == 12
    for run in runs:
        got, want = (
            sorted(tuple(r) for r in spark.read.parquet(f"{log.path}/runs/{run}").collect())
            for log in (all_at_once, one))
        if run.endswith("003"):
            assert {r[2] for r in got} == {"first"}  # a run that is there stays
        else:
            assert got == want
    assert sorted(map(tuple, all_at_once.read().collect())) == sorted(map(tuple, one.read().collect()))
