"""Spreading vector-by-vector work over tasks.

Vectors are hashed by id into groups; a tile is one group against another, and
one tile is one unit of work. A vector is copied once per group of the other
side, not once per vector, and ids are unique, so no tile is larger than the
others whatever the data: its size follows from the number of groups alone.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import has_direction

# Vectors per side of a tile: few enough for a task's memory (16,384 x 64 doubles
# are 8 MB), many enough that a vector is shuffled rarely.
SIDE_MIN, SIDE_MAX = 1024, 16_384
# Partitions of one shuffle; beyond it a partition works through several tiles.
PARTITIONS_MAX = 20_000


def groups_for(n: int, wanted: int, most: int = SIDE_MAX) -> int:
    """Number of groups for ``n`` vectors: ``wanted`` of them to keep all workers
    busy, fewer when the groups would be tiny, more when memory demands it."""
    return max(1, math.ceil(n / most), min(wanted, math.ceil(n / SIDE_MIN)))


def groups_for_square(n: int, workers: int) -> int:
    """Groups of a set paired with itself: about two tiles per worker."""
    return groups_for(n, math.ceil(2 * math.sqrt(workers)))


def place_tiles(rows: DataFrame, tiles: int) -> DataFrame:
    """Send each row to the partition of its ``tile``: tile by tile in turn, so that
    no partition gets two while another gets none."""
    return rows.repartitionById(min(tiles, PARTITIONS_MAX), F.col("tile"))


def group_of(key, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def usable(factors: DataFrame) -> DataFrame:
    """``(id, features)`` without null ids and without vectors that have no
    direction (zero, null or not finite): their cosine is undefined."""
    vectors = factors.select(F.col("id").cast("int").alias("id"), "features")
    return vectors.where(F.col("id").isNotNull() & has_direction("features"))


def workers_of(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism
