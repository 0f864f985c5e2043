"""WARC archives in Zstandard frames with a dictionary.

An archive begins with a skippable frame that holds the dictionary; each
record is one frame, so a reader can start at any record. Archives are written
by Spark's own text writer, one file a task, so that only files of committed
tasks appear, in whatever store the path names: a row is one frame, and the
line separator is an empty skippable frame, which every reader passes over."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sample_bound

# Fixed values of the formats: frame magics, and an empty skippable frame.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 1000             # shorter payloads are always stored
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 16   # what the dictionary is trained on
DICTIONARY_BYTES = 1 << 16

RECORD = ("page_id bigint, record_type string, target_uri string, payload_bytes bigint, payload_digest string, "
          "refers_to bigint, error string")


# --- writing

def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary trained on about SAMPLE_ROWS different payloads (those
    whose hash lies under a bound), of each at most SAMPLE_BYTES; empty where
    they are too few or too alike to train one."""
    rows = pages.where(F.col(html).isNotNull())
    under = sample_bound(rows.count(), SAMPLE_ROWS)
    rows = (rows.select(F.xxhash64(html).alias("h"), F.substring(html, 1, SAMPLE_BYTES).alias("t")).where(F.col("h") < under)
                .groupBy("h").agg(F.min("t").alias("t")).limit(4 * SAMPLE_ROWS).orderBy("h").collect())
    samples = [r.t.encode() for r in rows if r.t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _header_value(text: str) -> str:
    """A header value on one line: control characters and spaces are escaped."""
    return "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in text)


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None, date: str) -> bytes:
    """A response record with its payload, or a revisit of ``refers`` with the
    HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers is not None else 'response'}",
            f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packer(dictionary, date: str, level: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = dictionary.value
        comp = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data) if data else None,
                                        write_checksum=True, write_content_size=True)
        started = not data
        for batch in batches:
            frames = [] if started else [struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data]
            started = True
            ids, refers, urls, sums = (batch.column(c).to_pylist() for c in ("page_id", "refers_to", "url", "sha1"))
            html = batch.column("html").cast(pa.large_binary())
            for i in range(batch.num_rows):
                frames.append(comp.compress(make_record(ids[i], urls[i], html[i].as_py(), sums[i], refers[i], date)))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.large_binary())], names=["frame"])
    return pack


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   level: int = 3) -> None:
    """Write one record per row to archives in the new folder ``path``.

    Of rows with equal payloads of at least REVISIT_BYTES bytes those with the
    largest page_id are stored, the others revisit it. A null payload is
    empty; a null url has no target header; a null page_id is kept and sorts
    below all others."""
    spark = pages.sparkSession
    p = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                     F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1("html"))
    key = F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha2("html", 256))
    dups = (p.select("page_id", key.alias("key")).where("key IS NOT NULL").groupBy("key")
             .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL"))
    rows = p.withColumn("key", key).join(dups.select("key", "keeper"), "key", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("key", "keeper")
    dictionary = spark.sparkContext.broadcast(train_dictionary(p))   # at most DICTIONARY_BYTES
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    frames = rows.mapInArrow(_packer(dictionary, date, level), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


# --- reading

def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends: its blocks are walked by
    their headers, nothing is decoded."""
    flags = data[at + 4]
    pos = at + zstandard.frame_header_size(data[at:at + 18])
    while True:
        if pos + 3 > len(data):
            raise ValueError("the archive ends within a frame")
        block = int.from_bytes(data[pos:pos + 3], "little")
        pos += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)    # a run-length block stores one byte
        if block & 1:
            break
    pos += 4 * bool(flags & 4)
    if pos > len(data):
        raise ValueError("the archive ends within a frame")
    return pos


def read_frames(data: bytes) -> Iterator[bytes]:
    """The contents of the frames of an archive, one at a time."""
    at, dictionary = 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the archive ends within a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("the archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = data[8:8 + size]
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            opener = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
            yield opener.decompressobj().decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame starts at byte {at}")


def _id_of(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def parse_record(data: bytes) -> dict:
    """A record's fields; ``error`` says what does not hold (version, header
    lines, lengths, digest)."""
    out = dict.fromkeys(("page_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "error"))
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return out | {"error": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return out | {"error": "a header line without a name"}
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    kind = fields.get("warc-type")
    out |= {"page_id": _id_of(fields.get("warc-record-id")), "record_type": kind,
            "target_uri": fields.get("warc-target-uri"), "refers_to": _id_of(fields.get("warc-refers-to"))}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "the content length does not hold"}
    block = rest[:-4]
    http, sep, payload = block.partition(b"\r\n\r\n")
    claims = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    scheme, _, code = fields.get("warc-payload-digest", "").partition(":")
    try:
        digest = base64.b32decode(code).hex() if scheme == "sha1" else None
    except ValueError:
        digest = None
    if kind == "response":
        if digest != hashlib.sha1(payload).hexdigest():
            return out | {"error": "the payload digest does not hold"}
        if claims and claims[0] != b"%d" % len(payload):
            return out | {"error": "the payload length does not hold"}
        return out | {"payload_bytes": len(payload), "payload_digest": digest}
    if kind == "revisit":
        if digest is None or not claims or not claims[0].isdigit() or payload:
            return out | {"error": "a revisit without digest or length, or with a payload"}
        return out | {"payload_bytes": int(claims[0]), "payload_digest": digest}
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    names = [f.split()[0] for f in RECORD.split(", ")]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names],
                                          names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows: list[dict] = []
            try:
                for data in read_frames(content.as_py()):
                    rows.append(parse_record(data))
                    if len(rows) == 4096:
                        yield flush(rows)
                        rows = []
            except (ValueError, zstandard.ZstdError) as e:
                rows.append(dict.fromkeys(names) | {"error": str(e)})
            if rows:
                yield flush(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``: page_id, record_type,
    target_uri, payload_bytes and payload_digest (hex SHA-1) of the full
    payload, refers_to, and error (null for a valid record). A damaged archive
    gives its records up to the damage and one row with the error."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader, RECORD)


def archive_round_trip(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
                       html: str = "html") -> DataFrame:
    """Write ``pages`` to archives in ``path`` and read them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    write_archives(pages, path, page_id, url, html)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
