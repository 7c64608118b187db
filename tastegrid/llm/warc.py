"""Web archives with one Zstandard frame per record, written and read as Spark jobs.

An archive starts with a skippable frame that holds the dictionary; each record is a
frame of its own, compressed with it. Between records stands an empty skippable frame,
which every Zstandard reader passes over: it is the line separator with which Spark's
text writer joins the frames, so that archives are written through Spark's commit
protocol to any file system, and a task that runs twice leaves one file.
"""

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path
from .stages import staged

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
EMPTY_FRAME = struct.pack("<II", SKIPPABLE_FIRST, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Payloads of this many bytes and more are stored once.
LEAST_BYTES = 1000
# Payload bytes of one archive; its file is held by one task when it is read.
ARCHIVE_BYTES = 64 << 20
# The dictionary is fitted on at most so many pages, on so many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 8192, 16 << 10

RECORD = (
    "page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


class BadRecord(ValueError):
    """An archive that doesn't hold what its headers say."""


# --- records as bytes

def record_bytes(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record. A revisit holds the HTTP headers of its page only."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    block = http + payload
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(refers_to))]
        block = http
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The values of ``RECORD``; raises BadRecord where headers and content differ."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version != VERSION:
        raise BadRecord(f"no record header: {data[:40]!r}")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadRecord(f"no {name}")
    length = _number(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"a block of {len(rest) - 4} bytes, said to have {length}")
    block, kind = rest[:length], fields["warc-type"]
    status, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise BadRecord("no HTTP headers")
    said = _number(_fields(status.partition(b"\r\n")[2]).get("content-length", ""))
    digest = fields.get("warc-payload-digest", "")
    if not re.fullmatch("sha1:[A-Z2-7]{32}", digest):
        raise BadRecord(f"no SHA-1 digest: {digest!r}")
    sha1 = base64.b32decode(digest[5:]).hex()
    refers_to = None
    if kind == "response":
        if len(payload) != said or hashlib.sha1(payload).hexdigest() != sha1:
            raise BadRecord("the payload differs from its length or digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise BadRecord("a revisit with a payload or without a record it refers to")
        payload, refers_to = None, _page_id(fields["warc-refers-to"])
    else:
        raise BadRecord(f"unknown record type {kind!r}")
    url = fields.get("warc-target-uri")
    return (
        _page_id(fields["warc-record-id"]), None if url is None else _plain(url),
        kind, refers_to, said, sha1, payload,
    )


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode().split("\r\n") if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _number(text: str) -> int:
    if not re.fullmatch("[0-9]+", text):
        raise BadRecord(f"no length: {text!r}")
    return int(text)


def _uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str):
    match = re.fullmatch("<urn:page:(-?[0-9]*)>", uri)
    if not match:
        raise BadRecord(f"no page in {uri!r}")
    return int(match[1]) if match[1] else None


def _one_line(url: str) -> str:
    """``url`` for a header: white space, control characters and % are escaped."""
    return re.sub(r"[\s\x00-\x20\x7F%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _plain(url: str) -> str:
    raw = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url.encode())
    return raw.decode()


# --- frames

def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def frames(data: bytes):
    """The content of each frame of an archive; a dictionary, if any, comes first."""
    view, at, decompressor = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise BadRecord("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if at + 8 + size > len(view):
                raise BadRecord("the archive ends inside a skippable frame")
            if at == 0 and magic == DICTIONARY_FRAME:
                stored = bytes(view[8:8 + size])
                if stored[:4] == zstandard.FRAME_HEADER:
                    stored = zstandard.ZstdDecompressor().decompress(stored)
                decompressor = zstandard.ZstdDecompressor(
                    dict_data=zstandard.ZstdCompressionDict(stored)
                )
            at += 8 + size
            continue
        one, parts = decompressor.decompressobj(), []
        try:
            while not one.eof:
                if at >= len(view):
                    raise BadRecord("the archive ends inside a record")
                step = view[at:at + 16384]
                parts.append(one.decompress(step))
                at += len(step) - len(one.unused_data)
        except zstandard.ZstdError as error:
            raise BadRecord(f"a frame can't be read: {error}") from error
        yield b"".join(parts)


# --- jobs

def fit_dictionary(pages: DataFrame) -> bytes | None:
    """A dictionary from at most SAMPLE_PAGES pages, those with the smallest hash; None
    where they are too few or too small for one."""
    part = F.encode(F.substring("html", 1, SAMPLE_BYTES), "utf-8").alias("part")
    hashed = pages.select(part).where(F.length("part") >= 64).withColumn("hash", F.xxhash64("part"))
    # Only hashes are ordered; the pages that have the smallest are read after that.
    least = hashed.select("hash").distinct().orderBy("hash").limit(SAMPLE_PAGES)
    last = least.agg(F.max("hash")).first()[0]
    if last is None:
        return None
    sample = hashed.where(F.col("hash") <= F.lit(last)).groupBy("hash").agg(F.min("part").alias("part"))
    parts = [bytes(row["part"]) for row in sample.orderBy("hash").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return None


def find_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, payload_key, refers_to)`` of pages whose payload another page holds."""
    keys = staged(
        pages.select("page_id", *_payload("html"))
        .where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()),
        "payload-keys",
    )
    holders = staged(
        keys.groupBy("payload_key").agg(F.max("page_id").alias("refers_to"),
                                        F.count("*").alias("n"))
        .where("n > 1").select("payload_key", "refers_to"),
        "payload-holders",
    )
    return (
        keys.join(holders, "payload_key").where("page_id <> refers_to")
        .select("page_id", "payload_key", "refers_to").distinct()
    )


def _payload(html: str):
    body = F.coalesce(F.col(html), F.lit(""))
    return F.sha2(body, 256).alias("payload_key"), F.octet_length(body).alias("payload_bytes")


def write_archives(pages: DataFrame, path: str, date: str = "2025-01-01T00:00:00Z",
                   least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages (page_id, url, html)`` as archives at ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
    largest page_id holds the payload, and the others refer to it. A null payload is
    empty. Pages without page_id can't be referred to and are written whole. A page_id
    that occurs twice with one payload is written twice, each time in the same form.
    """
    pages = pages.select("page_id", "url", "html")
    revisits = staged(find_revisits(pages, least_bytes), "revisits")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = 1 + total // archive_bytes
    dictionary = fit_dictionary(pages)
    rows = (
        pages.withColumn("payload_key", _payload("html")[0])
        .repartition(archives, "page_id", "payload_key")
        .join(revisits, ["page_id", "payload_key"], "left")
        .select("page_id", "url", "html", "refers_to")
        .sortWithinPartitions("page_id")
    )

    def compress(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=data)
        lead = [dictionary_frame(dictionary)] if dictionary else []
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            columns[2] = columns[2].cast(pa.binary())
            out, held = lead, 0
            lead = []
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                record = record_bytes(page_id.as_py(), url.as_py(), html.as_py() or b"",
                                      refers_to.as_py(), date)
                out.append(compressor.compress(record))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (
        rows.mapInArrow(compress, "value binary").select(F.col("value").cast("string"))
        .write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path)
    )


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives at ``path``, with the columns of ``RECORD``.

    Lengths, required headers and the digest of each payload are checked; an archive
    that fails raises BadRecord. A revisit has no payload of its own; its length and
    digest are those of the page it was found equal to. ``payload=False`` leaves the
    payloads null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)],
            schema=schema,
        )

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in frames(content.as_py()):
                    record = parse_record(data)
                    rows.append(record if payload else (*record[:6], None))
                    held += len(data) if payload else 200
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("content").mapInArrow(decode, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives below the shared folder, and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payload=False)
