"""Packing by powers of two: each document is cut into pieces of binary length, each
piece is a sequence of its own, and sequences of equal length go to one bucket. No
sequence crosses documents, and none is padded."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import added_tokens, encoded, encoder

LIMIT = 2048
END = 1
# Ids that are gathered before they are passed on.
FLUSH = 1 << 19

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, "
    "ids array<int>"
)


def binary_lengths(count: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``count`` ids: the limit as often as it fits, and then
    the powers of two that sum to the rest, from the largest down."""
    whole, rest = divmod(count, limit)
    powers = [1 << bit for bit in range(limit.bit_length() - 1, -1, -1) if rest >> bit & 1]
    return [limit] * whole + powers


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         limit: int = LIMIT, end: int = END, vocabulary: str | None = None,
         with_ids: bool = True, added_from: str | None = None) -> DataFrame:
    """The pieces of each document of ``docs``, its ids followed by the id ``end``.

    ``limit``, a power of two, is the longest sequence; ``vocabulary`` the path of the
    tokenizer's ranks and ``added_from`` that of the file that names its added tokens, which
    are one id wherever a text holds them. Columns: those of PIECE, sequence_id and offset (0, since a
    piece fills its sequence). bucket is the binary logarithm of the length.
    ``with_ids=False`` leaves the ids null.

    A null or empty text is the id ``end`` alone. Repeated rows are packed each on
    their own, rows without id too. Documents are taken one by one: no shuffle.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError(f"the limit is a power of two, not {limit}")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()),
        ("ids", pa.list_(pa.int32())),
    ])

    def cut(batches):
        encode, added = encoder(vocabulary), added_tokens(added_from)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)],
                schema=schema,
            )

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, at = doc_id.as_py(), 0
                ids = np.append(encoded(encode, text.as_py() or "", added), np.uint32(end)).astype("<u4")
                for length in binary_lengths(len(ids), limit):
                    piece = ids[at:at + length]
                    rows.append((
                        doc_id, at, length, zlib.crc32(piece.tobytes()), len(ids),
                        length.bit_length() - 1, piece.astype(np.int32) if with_ids else None,
                    ))
                    at += length
                held += len(ids)
                if held > FLUSH:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    pieces = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(cut, PIECE)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces with a folder for each bucket: a reader that takes batches
    from one folder gets sequences of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)
