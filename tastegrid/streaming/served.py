"""Served answers as a log of runs, merged from time to time.

Every batch of a query puts one run, a folder of its own, in one step; a replay finds it
there and leaves it. ``compact`` merges the runs that have come since into the table of the
latest answer of each (uid, mid), laid out by user, and notes in the new table which runs
are in it. A reader takes the last whole table and the runs that are not in it: a small
number of them, whatever the age of the log.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import SERVED_REALTIME_RECS
from ..sources import files, layout

# Columns that place an answer among those of its (uid, mid): the start of its query, so
# that a query with a new checkpoint comes after the ones before, then the batch.
PLACE = ["query", "batch_id"]
_NAMES = [*SERVED_REALTIME_RECS.names, *PLACE]
_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SERVED_REALTIME_RECS)
_ROWS += ", query long, batch_id long"


class ServedLog:
    """The log at ``path``, for the query numbered ``query``.

    Numbers grow with each new checkpoint; ``number_of`` gives the one that belongs to a
    checkpoint. The log is a sink: ``Tables(sink=ServedLog(spark, path, query).sink)``.
    """

    def __init__(self, spark: SparkSession, path: str, query: int = 0, parts: int = 64):
        self.spark, self.path, self.query, self.parts = spark, path.rstrip("/"), query, parts

    @staticmethod
    def number_of(spark: SparkSession, path: str, checkpoint: str) -> int:
        """The number of the query with this checkpoint: a new one is counted on. It lies
        in the log, so a restart finds the number it had."""
        log = f"{path.rstrip('/')}/queries"
        known = [name.split("-", 1) for name in files.folders(spark, log)]
        name = layout_name(checkpoint)
        for number, other in known:
            if other == name:
                return int(number)
        number = max((int(n) for n, _ in known), default=0) + 1
        files.put(spark.createDataFrame([(checkpoint,)], "checkpoint string"), f"{log}/{number:06d}-{name}")
        return number

    # --- writing

    def sink(self, answers: DataFrame, batch_id: int) -> None:
        """Put the answers of a batch, unless an earlier try has done so."""
        rows = answers.select(
            *SERVED_REALTIME_RECS.names, F.lit(self.query).cast("long").alias("query"),
            F.lit(batch_id).cast("long").alias("batch_id"),
        )
        files.put(latest(rows).sortWithinPartitions("uid", "mid"), self._run(self.query, batch_id))

    def sink_all(self, answers: DataFrame) -> None:
        """Put the answers of many batches ``(uid, mid, recs, batch_id)``, each as its own
        run, in one job: what ``sink`` does batch by batch. Runs that are there are left."""
        rows = answers.select(
            *SERVED_REALTIME_RECS.names, F.lit(self.query).cast("long").alias("query"),
            F.col("batch_id").cast("long").alias("batch_id"),
        )
        run = F.format_string("%06d-%012d", "query", "batch_id")
        hidden = f"{self.path}/.filling-{uuid.uuid4().hex}"
        (
            latest(rows, "batch_id").withColumn("run", run).repartition("run")
            .sortWithinPartitions("run", "uid", "mid")
            .write.partitionBy("run").parquet(hidden)
        )
        files.make(self.spark, f"{self.path}/runs")
        for name in files.folders(self.spark, hidden):
            target = f"{self.path}/runs/{name.split('=', 1)[1]}"
            if not files.exists(self.spark, target):
                files.rename(self.spark, f"{hidden}/{name}", target)
        files.remove(self.spark, hidden)

    def _run(self, query: int, batch_id: int) -> str:
        return f"{self.path}/runs/{query:06d}-{batch_id:012d}"

    # --- reading

    def tables(self) -> list[str]:
        return files.folders(self.spark, f"{self.path}/tables")

    def merged(self) -> set[str]:
        """The runs that the last table holds."""
        found = self.tables()
        if not found:
            return set()
        rows = self.spark.read.parquet(f"{self.path}/tables/{found[-1]}/merged").collect()
        return {row["run"] for row in rows}

    def waiting(self) -> list[str]:
        """The runs that no table holds yet."""
        done = self.merged()
        return [run for run in files.folders(self.spark, f"{self.path}/runs") if run not in done]

    def _rows(self, runs: list[str], uids: DataFrame | None = None,
              bound: int | None = None) -> DataFrame:
        parts = [self.spark.createDataFrame([], _ROWS)]
        found = self.tables()
        if found:
            table = self.spark.read.parquet(f"{self.path}/tables/{found[-1]}/rows")
            parts.append(layout.plain(table) if uids is None else layout.rows_of(table, "uid", uids, bound))
        if runs:
            rows = self.spark.read.schema(_ROWS).parquet(*[f"{self.path}/runs/{run}" for run in runs])
            parts.append(rows if uids is None else layout.rows_of(rows, "uid", uids, bound))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part.select(*_NAMES))
        return rows

    def read(self) -> DataFrame:
        """The latest answer of every (uid, mid)."""
        return latest(self._rows(self.waiting()))

    def lookup(self, asked: DataFrame, bound: int | None = None) -> DataFrame:
        """The latest answers for ``asked (uid, mid)``: of the merged table only the parts
        of the users asked for are read."""
        rows = self._rows(self.waiting(), asked.select("uid"), bound)
        wanted = asked.select("uid", "mid").distinct()
        return latest(rows.join(wanted, ["uid", "mid"], "left_semi"))

    # --- merging

    def compact(self) -> str | None:
        """Merge the waiting runs into a new table; returns its name, or None where there
        are none. One compaction runs at a time. The table before stays for readers that
        use it; it and the runs it held go with the next but one."""
        runs = self.waiting()
        if not runs:
            return None
        before = self.tables()
        name = f"{int(before[-1]) + 1 if before else 1:09d}"
        hidden = f"{self.path}/tables/.{name}"
        layout.write_laid_out(
            latest(self._rows(runs)), f"{hidden}/rows", "uid", self.parts, mode="overwrite")
        held = sorted(self.merged() | set(runs))
        self.spark.createDataFrame([(run,) for run in held], "run string").coalesce(1).write.mode(
            "overwrite").parquet(f"{hidden}/merged")
        files.rename(self.spark, hidden, f"{self.path}/tables/{name}")
        return name

    def clean(self) -> None:
        """Remove the tables before the last two, and the runs that both of these hold."""
        found = self.tables()
        if len(found) < 2:
            return
        for old in found[:-2]:
            files.remove(self.spark, f"{self.path}/tables/{old}")
        rows = self.spark.read.parquet(f"{self.path}/tables/{found[-2]}/merged").collect()
        for run in {row["run"] for row in rows} & set(files.folders(self.spark, f"{self.path}/runs")):
            files.remove(self.spark, f"{self.path}/runs/{run}")


def latest(rows: DataFrame, *within: str) -> DataFrame:
    """The last answer per (uid, mid), or per those and the columns ``within``; equal places,
    of one batch, hold equal answers."""
    place = F.struct(*PLACE)
    return rows.groupBy("uid", "mid", *[F.col(c).alias(f"_{c}") for c in within]).agg(
        F.max_by("recs", place).alias("recs"), F.max(place).alias("place")
    ).select("uid", "mid", "recs", "place.query", "place.batch_id")


def layout_name(text: str) -> str:
    """A text as part of a folder's name."""
    return "".join(c if c.isalnum() else "_" for c in text.rstrip("/"))
