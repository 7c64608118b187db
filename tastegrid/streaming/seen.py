"""What users have rated, kept as state of the stream.

A batch that leaves out rated items needs what its users have rated. The state holds that
for every user: it is filled from the stored ratings when the stream starts, and grows by
the ratings that the stream itself brings. A batch then reads no stored ratings.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.tiles import group_of

# A key of the state is a group of users and a block of so many item ids, so that no key holds
# more items of one user than that, however much the user has rated.
BLOCK_ITEMS = 1 << 16
# Groups of users. A key costs tens of milliseconds in a batch that asks for it, most of them
# spent waiting, so users have none of their own.
GROUPS = 4096
# Parts over which messages are dealt that change no state.
PASSING = 64

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """A query that starts in here keeps its state in RocksDB, which this kind of state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def item_block(mid: Column, blocks: int) -> Column:
    """The block of an item id; ids beyond the last block start again with the first."""
    return F.pmod(F.floor(mid / BLOCK_ITEMS), F.lit(blocks)).cast("int")


def _group(user: Column, groups: int) -> Column:
    return group_of(user.cast("int"), groups)


def _codes(uid, mid) -> np.ndarray:
    """Pairs (user, item) as whole numbers that sort by user, each once."""
    uid, mid = np.asarray(uid, np.int64), np.asarray(mid, np.int64)
    return np.unique((uid << 32) | (mid & 0xFFFFFFFF))


class RatedItems(StatefulProcessor):
    """The items that a group's users have rated, of one block of ids: a value of sorted pairs.

    Input rows carry a message where ``own`` is true, and otherwise only ask. Out come the
    messages as they are, and for a user who is asked about one row per rated item, with the
    item as ``other``. With ``remember`` the items of the messages are rated from the next batch
    on. Keys with a negative block are messages that have no state.
    """

    def __init__(self, columns: list[str], remember: bool):
        self.columns, self.remember = columns, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rated = handle.getValueState("rated", "pairs binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # A key with many rows comes in several frames.
        self._keep(self._held(), _codes(initialState["user"], initialState["mid"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keyed = key[1] >= 0
        asked, brought = [], []
        for frame in rows:
            if keyed:
                asked.append(frame["uid"].unique())
            messages = frame[frame["own"]][self.columns]
            if not len(messages):
                continue
            if keyed and self.remember:
                brought.append(_codes(messages["uid"], messages["mid"]))
            yield messages.assign(other=pd.array([None] * len(messages), "Int32"))
        if not asked:
            return
        before = self._held()
        wanted = before[np.isin(before >> 32, np.concatenate(asked))]
        if len(wanted):
            seen = {column: None for column in self.columns} | {
                "uid": (wanted >> 32).astype(np.int32),
                "other": (wanted & 0xFFFFFFFF).astype(np.uint32).view(np.int32),
            }
            yield pd.DataFrame(seen, columns=[*self.columns, "other"])
        if brought:
            self._keep(before, np.concatenate(brought))

    def _held(self) -> np.ndarray:
        held = self.rated.get()
        return np.frombuffer(held[0], np.int64) if held else np.empty(0, np.int64)

    def _keep(self, before: np.ndarray, brought: np.ndarray) -> None:
        pairs = np.union1d(before, brought)
        if len(pairs) > len(before):
            self.rated.update((pairs.tobytes(),))

    def close(self) -> None:
        pass


def with_rated_items(parsed: DataFrame, rated: DataFrame | None, blocks: int = 1,
                     remember: bool = True, groups: int = GROUPS) -> DataFrame:
    """The stream ``parsed (uid, mid, reason, ...)``, and rows ``(uid, other)`` of what the
    users of a batch had rated before it.

    ``rated (uid, mid)`` fills the state when the stream starts for the first time; a
    restart goes on with the state it left. ``blocks`` is the number of blocks of item ids,
    1 for up to ``BLOCK_ITEMS`` items; it and the number of ``groups`` of users stay the
    same for a checkpoint.
    """
    columns = parsed.columns
    good = F.col("reason").isNull()
    all_blocks = F.sequence(F.lit(0), F.lit(blocks - 1))
    beside = F.array((-1 - F.pmod(F.xxhash64(*columns), F.lit(PASSING))).cast("int"))
    rows = parsed.withColumn("block", F.explode(F.when(good, all_blocks).otherwise(beside)))
    rows = rows.withColumn("own", ~good | (F.col("block") == item_block(F.col("mid"), blocks)))
    # Messages without state are in as many keys as they have blocks, whoever sent them.
    rows = rows.withColumn("grp", F.when(good, _group(F.col("uid"), groups)).otherwise(0))
    state = None
    if rated is not None:
        pairs = rated.where("uid is not null and mid is not null").select(
            F.col("uid").cast("int").alias("user"), F.col("mid").cast("int").alias("mid")
        )
        state = (
            pairs.distinct().withColumn("block", item_block(F.col("mid"), blocks))
            .withColumn("grp", _group(F.col("user"), groups)).groupBy("grp", "block")
        )
    return rows.groupBy("grp", "block").transformWithStateInPandas(
        RatedItems(columns, remember), StructType([*parsed.schema, StructField("other", IntegerType())]), "append", "none", state
    )
