"""Factor model: fit, predict, recommend, evaluate, tune."""

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, functions as F

from ..schemas import FACTORS, RATINGS, TUNING, conform
from ..session import fresh_path, staged
from .similarity import THRESHOLD, similar_items
from .topn import topn_from_factors

# Settings of the production model and of the tuning grid.
RANK, MAX_ITER, REG = 30, 10, 0.01
GRID_RANKS, GRID_REGS, GRID_MAX_ITER = (10, 20, 30), (0.001, 0.01, 0.1), 50
TRAIN_FRACTION = 0.8
# Iterations of the rungs of a search, and the share of points that goes on to the next.
RUNGS, KEEP = (5, 15, 50), 1 / 3
RUNG_ROWS = "iterations int, rank int, reg double, rmse double"
# User and item blocks of the solver, Spark's own default. The result depends on the user
# blocks, so they don't follow the machine; for a large cluster the caller gives more.
BLOCKS = 10
# Ratings of one item block, whose task holds them: more ratings make more item blocks. The
# solver starts from the users' vectors, so that the model is the same.
BLOCK_RATINGS = 8_000_000
# Iterations whose vectors lie on the executors' disks: after so many the solver stores the
# items' vectors in the shared folder and drops the shuffles before. The model is the same.
# A search fits several models of more iterations, and stores them half as often.
KEPT_ITERATIONS, KEPT_IN_SEARCH = 1, 2


def complete_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings with both keys and a score: the fit accepts no null, and no NaN."""
    ratings = conform(ratings, RATINGS)
    missing = _missing()
    return ratings.where(~(missing["uid"] | missing["mid"] | missing["score"]))


def _missing() -> dict:
    """For each column, the condition that a rating lacks it."""
    missing = {c: F.col(c).isNull() for c in ("uid", "mid", "score")}
    return missing | {"score": missing["score"] | F.isnan("score")}


def dropped_ratings(ratings: DataFrame) -> DataFrame:
    """How many rows the fit leaves out ``(total, null_uid, null_mid, null_score, dropped)``."""
    null = _missing()
    return conform(ratings, RATINGS).agg(
        F.count("*").alias("total"),
        *[F.count_if(cond).alias(f"null_{c}") for c, cond in null.items()],
        F.count_if(null["uid"] | null["mid"] | null["score"]).alias("dropped"),
    )


def mean_per_pair(ratings: DataFrame) -> DataFrame:
    """One row per (uid, mid) with the mean score: repeated ratings count once."""
    return ratings.groupBy("uid", "mid").agg(F.avg("score").alias("score"))


def fit_als(ratings: DataFrame, rank: int = RANK, max_iter: int = MAX_ITER,
            reg: float = REG, seed: int = 42, blocks: int | None = None,
            one_per_pair: bool = False) -> ALSModel:
    """Explicit-feedback ALS over all complete ratings.

    The ratings are stored once: they are counted, and the solver reads them more than once
    to build its blocks. ``blocks`` is the number of user and of item blocks; by default BLOCKS, and more item
    blocks for more ratings. The same user blocks and seed give the same model on any
    cluster. The lineage of the iterations is cut in the shared folder, and
    the returned model is the one saved there: no later job can fall back to
    repeating the fit.
    """
    spark = ratings.sparkSession
    path = fresh_path(spark, "als-model")
    data = complete_ratings(ratings)
    if one_per_pair:
        data = mean_per_pair(data)
    data = staged(data, "ratings-to-fit")
    item_blocks = blocks or item_blocks_for(data)
    _als(rank, max_iter, reg, seed, blocks or BLOCKS, item_blocks).fit(data).save(path)
    return ALSModel.load(path)


def item_blocks_for(ratings: DataFrame) -> int:
    """Item blocks of a fit of ``ratings``: BLOCKS, or as many as keep a block's ratings few."""
    return max(BLOCKS, math.ceil(ratings.count() / BLOCK_RATINGS))


def _als(rank: int, max_iter: int, reg: float, seed: int, blocks: int,
         item_blocks: int | None = None, kept: int = KEPT_ITERATIONS) -> ALS:
    """The solver. Its blocks lie on the executors' disks: each is read once in an iteration,
    and the memory is for the vectors that meet in a block."""
    return ALS(
        rank=rank, maxIter=max_iter, regParam=reg, seed=seed,
        userCol="uid", itemCol="mid", ratingCol="score",
        numUserBlocks=blocks, numItemBlocks=item_blocks or blocks, coldStartStrategy="drop",
        checkpointInterval=kept, intermediateStorageLevel="DISK_ONLY",
    )


def user_factors(model: ALSModel) -> DataFrame:
    return conform(model.userFactors, FACTORS)


def item_factors(model: ALSModel) -> DataFrame:
    return conform(model.itemFactors, FACTORS)


def predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``prediction``; pairs of an unseen user or item drop out."""
    return model.setColdStartStrategy("drop").transform(pairs)


def user_topn(model: ALSModel, k: int = 10, exclude_seen: DataFrame | None = None) -> DataFrame:
    """The ``k`` best items of every user ``(uid, recs)``.

    ``exclude_seen`` takes the ratings whose (uid, mid) must not be recommended.
    """
    return topn_from_factors(user_factors(model), item_factors(model), k, exclude_seen)


def model_similar_items(model: ALSModel, threshold: float = THRESHOLD,
                        k: int | None = None) -> DataFrame:
    """The neighbour table of the model's items."""
    return similar_items(item_factors(model), threshold, k)


def split_ratings(ratings: DataFrame, fraction: float = TRAIN_FRACTION,
                  seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Random split into training and test rows."""
    train, test = ratings.randomSplit([fraction, 1.0 - fraction], seed)
    return train, test


def split_ratings_by_key(ratings: DataFrame, tenths: int = 8) -> tuple[DataFrame, DataFrame]:
    """Split decided by each row's own keys: the same on every run and retry."""
    bucket = F.pmod(F.col("uid").cast("bigint") * 31 + F.col("mid"), F.lit(10))
    return ratings.where(bucket < tenths), ratings.where(bucket >= tenths)


def rmse(scored: DataFrame, label: str = "score", prediction: str = "prediction",
         by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error ``(*by, rmse)``."""
    error = F.col(prediction) - F.col(label)
    return scored.groupBy(*by).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def grid_search(ratings: DataFrame, ranks: Sequence[int] = GRID_RANKS,
                regs: Sequence[float] = GRID_REGS, max_iter: int = GRID_MAX_ITER,
                seed: int = 42, parallelism: int = 3, blocks: int | None = None) -> DataFrame:
    """RMSE on held-out rows for every (rank, reg) ``(rank, reg, rmse)``.

    The ratings are written to the shared folder once, each with the part it is in, so
    that every fit, and every retry of a lost task, sees the same rows, and no row is
    in both parts or in none. ``parallelism`` fits run at a time.
    """
    drawn = _drawn(ratings, seed)
    grid = [(rank, reg) for rank in ranks for reg in regs]
    rows = _errors(drawn, grid, max_iter, seed, parallelism, blocks)
    return ratings.sparkSession.createDataFrame(rows, TUNING)


def _drawn(ratings: DataFrame, seed: int) -> DataFrame:
    return staged(
        complete_ratings(ratings).withColumn("is_train", F.rand(seed) < TRAIN_FRACTION), "drawn"
    )


def _errors(drawn: DataFrame, grid: Sequence[tuple[int, float]], max_iter: int, seed: int,
            parallelism: int, blocks: int | None) -> list[tuple[int, float, float]]:
    """``(rank, reg, rmse)`` of the points, each fitted with ``max_iter`` iterations."""
    train, test = drawn.where("is_train"), drawn.where("not is_train")
    item_blocks = blocks or item_blocks_for(train)

    @inheritable_thread_target(drawn.sparkSession)
    def one(point: tuple[int, float]) -> tuple[int, float, float]:
        rank, reg = point
        solver = _als(rank, max_iter, reg, seed, blocks or BLOCKS, item_blocks, KEPT_IN_SEARCH)
        model = solver.fit(train)
        return rank, reg, rmse(predict(model, test)).first()["rmse"]

    with ThreadPool(max(1, min(parallelism, len(grid)))) as pool:
        return pool.map(one, grid, chunksize=1)


def rung_search(ratings: DataFrame, ranks: Sequence[int] = GRID_RANKS,
                regs: Sequence[float] = GRID_REGS, rungs: Sequence[int] = RUNGS,
                keep: float = KEEP, seed: int = 42, parallelism: int = 3,
                blocks: int | None = None) -> DataFrame:
    """RMSE of the points of a grid, rung by rung ``(iterations, rank, reg, rmse)``.

    All points are fitted with the iterations of the first rung, the share ``keep`` of them
    with the smallest errors, one at least, with those of the second, and so on. The same
    held-out rows judge every fit. ``best_params`` of the last rung gives the point; the
    grid's nine points cost 140 iterations instead of 450.
    """
    drawn = _drawn(ratings, seed)
    points = [(rank, reg) for rank in ranks for reg in regs]
    rows = []
    for iterations in rungs:
        found = _errors(drawn, points, iterations, seed, parallelism, blocks)
        rows += [(iterations, *row) for row in found]
        # A point without an error, when every held-out row is cold, comes last.
        order = sorted(found, key=lambda r: (r[2] is None or r[2] != r[2], r[2] or 0.0, r[0], r[1]))
        points = [row[:2] for row in order[:max(1, math.ceil(len(order) * keep))]]
    return ratings.sparkSession.createDataFrame(rows, RUNG_ROWS)


def best_params(results: DataFrame) -> DataFrame:
    """The row of ``results (rank, reg, rmse)`` with the smallest error."""
    row = F.struct("rank", "reg", "rmse")
    order = F.struct("rmse", "rank", "reg")
    usable = results.where(F.col("rmse").isNotNull() & ~F.isnan("rmse"))
    return usable.agg(F.min_by(row, order).alias("best")).select("best.*")
