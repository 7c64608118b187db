"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations learned on a sample turn each vector into balanced bits. The bits are cut into
substrings, one for each table; vectors that agree in a substring meet in a bucket of its
table, where their cosines are taken from the original vectors. Substrings grow with the
logarithm of the vectors, so that a bucket stays small, and tables with them, so that the
recall stays.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .runs import roots, runs
from .stages import staged

LEAST_COSINE = 0.98
# Share of the pairs just at the least cosine that some table is to bring together; bits of
# a substring at least, and vectors that a bucket of random ones holds.
RECALL, LEAST_BITS, PER_BUCKET = 0.99, 10, 4
# Vectors that the rotation is fitted on: so many at most, and so many numbers; those
# with the smallest hash.
SAMPLE, SAMPLE_NUMBERS, ROUNDS = 20_000, 4_000_000, 40
# Vectors of a group in a tile of a bucket.
TILE = 512


# --- codes

def table_plan(largest: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """``(bits, tables)`` for ``largest`` vectors of one label: a random vector agrees in a
    substring with few of them, and two at the cosine ``least`` with the given recall in
    one of the tables. Each bit tells these apart by the part that their angle is of 180
    degrees."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, largest) / PER_BUCKET)))
    agree = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    if agree >= recall:
        return bits, 1
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def fit_rotation(sample: np.ndarray, bits: int, seed: int = 3) -> np.ndarray:
    """The projection of unit vectors whose signs are their bits: the leading directions,
    rotated so that the numbers lie as near as can be to their signs. Another ``seed``
    starts from another rotation, and ends with other bits.

    The vectors are not centred. Angles between vectors decide here, and around a centre
    that lies within a dense group they would say nothing about that group."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    directions = vectors[:, ::-1][:, :bits]
    seen = sample @ directions
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(ROUNDS):
        signs = np.where(seen @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(seen.T @ signs)
        rotation = left @ right
    return directions @ rotation


def fit_rotations(sample: np.ndarray, bits: int, tables: int) -> list[np.ndarray]:
    """As many rotations as the tables' substrings need; each gives one bit a dimension at
    most, so vectors of few dimensions have shorter substrings."""
    dims = sample.shape[1]
    own = min(bits, dims)
    each = dims // own
    return [fit_rotation(sample, own * each, 3 + r) for r in range(-(-tables // each))]


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def substrings(vectors: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """The substring of each vector for each table, as a number."""
    own = min(bits, vectors.shape[1])
    powers = 1 << np.arange(own, dtype=np.int64)
    parts = [
        (vectors @ rotation >= 0).reshape(len(vectors), -1, own) @ powers for rotation in rotations
    ]
    return np.concatenate(parts, axis=1)[:, :tables]


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite numbers, not all of them 0, none null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def coded(one: DataFrame, bits: int, tables: int) -> DataFrame:
    """``one (vec_id, label, vector, copies)`` with each vector's substrings, ``keys``;
    rotations are fitted for each length that vectors have."""
    models = {}
    for row in one.select(F.size("vector").alias("n")).distinct().collect():
        most = max(1, min(SAMPLE, SAMPLE_NUMBERS // row["n"]))
        own = one.where(F.size("vector") == row["n"])
        sample = own.orderBy(F.xxhash64("vector"), "vec_id").limit(most).select("vector").toArrow()
        vectors = np.array(sample["vector"].to_pylist(), float)
        models[row["n"]] = fit_rotations(units(vectors), bits, tables)

    def encode(batches):
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(np.asarray(vectors.offsets)) if len(batch) else np.empty(0, int)
            out = np.zeros((len(batch), tables), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                out[at] = substrings(units(flat.reshape(len(at), size)), models[size], bits, tables)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables)
            keys = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, keys], names=[*batch.schema.names, "keys"]
            )

    kind = one.schema["vector"].dataType.simpleString()
    return one.mapInArrow(
        encode, f"vec_id long, label string, vector {kind}, copies long, keys array<long>"
    )


# --- tables

def bucket_members(codes_of: DataFrame) -> DataFrame:
    """``(tile, table, first, second, own, vec_id)``: in which buckets a vector meets
    others. A bucket of many is cut into groups; a tile is that of the ``first`` and the
    ``second`` group, which may be the same, and a vector is in its ``own``."""
    members = codes_of.select(
        "vec_id", "label", F.size("vector").alias("size"), F.posexplode("keys").alias("table", "key")
    ).select("vec_id", "table", F.xxhash64("label", "size", "table", "key").alias("bucket"))
    counts = staged(
        members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-counts"
    )
    groups = F.ceil(F.col("n") / TILE).cast("int")
    return (
        members.join(counts, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("vec_id", F.lit(5)), groups).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
        .select(
            F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
            "table", F.least("own", "other").alias("first"),
            F.greatest("own", "other").alias("second"), "own", "vec_id",
        )
    )


def linked(codes_of: DataFrame, tables: int, least: float = LEAST_COSINE) -> DataFrame:
    """``(vec_id, links, root)``: for each tile, how many vectors it links a vector with,
    copies counted, and the smallest id that the links of the tile lead to. A pair is
    counted in the first table in which it meets."""
    members = staged(bucket_members(codes_of), "bucket-members")
    kind = np.float32 if codes_of.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    rows = (
        members.join(codes_of, "vec_id")
        .select("tile", "table", "first", "second", "own", "vec_id", "copies", "keys", "vector")
        .repartition("tile").sortWithinPartitions("tile")
    )

    def compare(batches):
        def parts():
            for batch in batches:
                vectors = np.empty(len(batch), object)
                vectors[:] = list(_rows(batch.column(8), kind))
                keys = batch.column(7).flatten().to_numpy().reshape(-1, tables)
                yield (*(batch.column(i).to_numpy() for i in range(7)), keys, vectors)

        out, held = [], 0
        for group in runs(parts()):
            if len(group[0]) < 2:
                continue
            found = _links(group, least)
            if len(found[0]):
                out.append(found)
                held += len(found[0])
            if held > 10_000:
                yield _batch(out)
                out, held = [], 0
        yield _batch(out)

    return rows.mapInArrow(compare, "vec_id long, links long, root long")


def _rows(vectors: pa.Array, kind) -> list[np.ndarray]:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    offsets = np.asarray(vectors.offsets)
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _links(group, least: float):
    _, table, first, second, own, ids, copies, keys, vectors = group
    matrix = units(np.stack(vectors))
    links = matrix @ matrix.T >= least
    np.fill_diagonal(links, False)
    if first[0] != second[0]:
        links &= own[:, None] != own[None]
    if not links.any():
        return ids[:0], copies[:0], ids[:0]
    for key in keys.T[:table[0]]:
        links &= key[:, None] != key[None]
    order = np.argsort(ids, kind="stable")
    links, ids, copies = links[order][:, order], ids[order], copies[order]
    some = links.any(axis=1)
    return ids[some], (links @ copies)[some], ids[roots(links)][some]


def _batch(found) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64)) for c in columns], names=["vec_id", "links", "root"]
    )


# --- the operator

def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", least: float = LEAST_COSINE,
                 recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal labels are linked when their cosine, in double precision, is
    ``least`` or more and a table brings them together, as all but 1 - ``recall`` of those
    just at ``least`` are; n_links counts the other vectors linked directly, component_id is
    the smallest id reachable.

    A vector that is null, has no direction, or holds a null or non-finite number, and
    a row without label or id, is linked with nothing. Vectors of different lengths
    aren't either. Equal vectors are linked and are one to the tables, however many
    there are. Rows that share an id are each linked by their own vector.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("vector"),
    )
    fit = F.coalesce(usable(F.col("vector")), F.lit(False))
    some = rows.where(fit & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        "*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")
    )
    none = rows.where(~fit | F.col("vec_id").isNull() | F.col("label").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    one = staged(
        some.groupBy("label", "h1", "h2")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        "one-of-each-vector",
    )
    of_label = one.groupBy("label", F.size("vector")).agg(F.count("*").alias("n"))
    largest = of_label.agg(F.max("n")).first()[0] or 0
    bits, tables = table_plan(largest, least, recall)
    codes_of = staged(coded(one.select("vec_id", "label", "vector", "copies"), bits, tables), "codes")
    found = staged(linked(codes_of, tables, least), "vector-links")
    reached = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    classes = staged(
        one.select("label", "h1", "h2", "vec_id", "copies")
        .join(counts, "vec_id", "left")
        .join(reached.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("label", "h1", "h2",
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id")),
        "vector-classes",
    )
    return (
        some.select("vec_id", "label", "h1", "h2").join(classes, ["label", "h1", "h2"])
        .select("vec_id", "n_links", "component_id").union(none)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
