"""Dictionary-compressed web archives (operator 11).

An archive is a sequence of Zstandard frames: a skippable frame (magic 0x184D2A5D) that
holds a dictionary built from archived payloads, then one frame per WARC record, each
compressed by itself with that dictionary. Any tool for ``.warc.zst`` reads it.

Spark's text sink writes the files, one per task, and commits them, so archives may lie
in any store and survive lost executors. The sink ends every value with a line
separator; here the separator is itself an empty skippable frame, which decoders pass
over. The text source splits archives at the same separator, so a large file is read
by many tasks. No frame holds the separator inside: ``frame`` sees to that.

Payloads of ``least_bytes`` or more are equal if their SHA-256 is; the one with the
smallest page id is stored (``response``), the others refer to it (``revisit``). Rows
that repeat the smallest id with the same payload are responses as well. Null ids come
after all others; if all ids of equal payloads are null, all are responses. A null
payload is empty; a null url leaves out its header; other columns are ignored. An empty
table gives archives without records.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

SEPARATOR = b"P*M\x18\x00\x00\x00\x00"  # skippable frame 0x184D2A50 of length 0
DICTIONARY_MAGIC = b"]*M\x18"  # 0x184D2A5D, fixed by the format
DICTIONARY_BYTES = 112_640
SAMPLE_RECORDS, SAMPLE_RECORD_BYTES = 512, 65_536  # payloads that the dictionary is built from
MAX_DICTIONARIES = 64  # different dictionaries that a reader holds: 7 MB
LEVEL = 3
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def frame(data: bytes, dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    """One Zstandard frame without the separator in it. A copy of it in the data is
    broken by a block boundary; a chance match goes with another level."""
    plain = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress(data)
    if SEPARATOR not in plain:
        return plain
    cuts = [0, *(m.start() + 4 for m in re.finditer(re.escape(SEPARATOR), data)), len(data)]
    pieces = [data[lo:hi] for lo, hi in pairwise(cuts)]
    for level in range(1, 20):
        out = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True).compressobj(size=len(data))
        made = b"".join(out.compress(p) + out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) for p in pieces) + out.flush()
        if SEPARATOR not in made:
            return made
    raise ValueError("no level gives a frame without the separator")


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def page_record(page_id: str | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """A ``response`` with its payload, or a ``revisit`` of the page ``refers_to``."""
    headers = [("WARC-Record-ID", record_id(page_id))]
    if page_id is not None:
        headers.append(("Page-ID", page_id))
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        headers.append(("WARC-Target-URI", safe))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(size))]
    if refers_to is None:
        headers.append(("Content-Type", "application/http; msgtype=response"))
        return warc_record("response", headers, HTTP_HEAD + (payload or b""))
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", refers_to)]
    return warc_record("revisit", headers, b"")


def read_record(data: bytes) -> dict | None:
    """Fields of a page's record; None for other records. The payload is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind, length = fields["WARC-Type"], int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record of another length than its header says")
    if kind not in ("response", "revisit"):
        return None
    digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
    if kind == "response":
        payload = rest[:length].partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["Payload-Length"]):
            raise ValueError("payload unlike its digest")
    return {"page_id": fields.get("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload,
            "payload_bytes": int(fields["Payload-Length"]), "payload_digest": digest, "record_type": kind,
            "refers_to": fields.get("Refers-To-Page-ID")}


def dictionary_frame(dictionary: bytes) -> bytes:
    body = frame(dictionary, None)
    return DICTIONARY_MAGIC + struct.pack("<I", len(body)) + body


def train(payloads: DataFrame) -> bytes:
    """A dictionary from the column ``payload`` of a bounded sample; empty if it is too
    small to build one."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [v for batch in batches for v in batch.column("payload").to_pylist()]
        try:
            made = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
        except zstandard.ZstdError:
            return
        yield pa.RecordBatch.from_pydict({"d": pa.array([made], pa.binary())})

    rows = payloads.select("payload").coalesce(1).mapInArrow(work, "d binary").collect()
    return bytes(rows[0]["d"]) if rows else b""


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   least_bytes: int = 100) -> None:
    """Write one record per row of ``pages`` into archives under ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    digests = cut_lineage(rows.select("page_id", "digest", "size"), "payload-digests")
    first = digests.where(F.col("size") >= least_bytes).groupBy("digest") \
        .agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and leader is not null")
    least = digests.where(F.col("size").between(1, SAMPLE_RECORD_BYTES)).select("digest").distinct() \
        .orderBy("digest").limit(SAMPLE_RECORDS)
    last = least.agg(F.max("digest")).first()[0]
    sample = rows.where((F.col("digest") <= F.lit(last)) & F.col("size").between(1, SAMPLE_RECORD_BYTES)) \
        .groupBy("digest").agg(F.first("payload").alias("payload")).orderBy("digest")
    dictionary = train(sample) if last is not None else b""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared is not None:
            shared.precompute_compress(level=LEVEL)
        out: list[bytes] = []
        begun, size = False, 0
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if not begun:
                    begun = True
                    out += [dictionary_frame(dictionary)] if dictionary else []
                    out.append(frame(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                                              ("Content-Type", "application/warc-fields")],
                                                 b"format: WARC File Format 1.1\r\n"), shared))
                out.append(frame(page_record(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"]), shared))
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})

    # Short payloads have no leader: they are spread by their id instead of a digest.
    by = F.when(F.col("size") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.hash("page_id", "url"), F.lit(0))))
    roles = rows.withColumn("by", by).join(first.select(F.col("digest").alias("by"), "leader"), "by", "left") \
        .withColumn("again", F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")))
    records = roles.select(F.col("page_id").cast("string").alias("page_id"), "url", "digest", "size",
                           F.when(~F.col("again"), F.col("payload")).alias("payload"),
                           F.when(F.col("again"), F.col("leader").cast("string")).alias("refers_to"))
    records.mapInArrow(work, "frame binary").select(F.col("frame").cast("string").alias("value")) \
        .write.option("lineSep", SEPARATOR.decode()).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: ``page_id`` (string), ``url``, ``payload`` (null for a
    revisit), ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    frames = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary").alias("frame"))
    is_dictionary = F.substring("frame", 1, 4) == F.lit(DICTIONARY_MAGIC)
    found = frames.where(is_dictionary).groupBy(F.sha2("frame", 256).alias("id")).agg(F.first("frame").alias("frame")) \
        .limit(MAX_DICTIONARIES + 1).collect()
    if len(found) > MAX_DICTIONARIES:
        raise ValueError(f"archives of more than {MAX_DICTIONARIES} dictionaries: read them folder by folder")
    stored = [zstandard.ZstdDecompressor().decompress(bytes(r["frame"])[8:]) for r in found]
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {0: zstandard.ZstdDecompressor()}
        for d in map(zstandard.ZstdCompressionDict, stored):
            readers[d.dict_id()] = zstandard.ZstdDecompressor(dict_data=d)
        out: list[dict] = []
        size = 0

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)],
                                              names=columns)

        for batch in batches:
            for value in batch.column("frame"):
                raw = value.as_py()
                r = read_record(readers[zstandard.get_frame_parameters(raw).dict_id].decompressobj().decompress(raw))
                if r is not None:
                    out.append(r)
                    size += 256 + len(r["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    return frames.where(~is_dictionary).mapInArrow(
        work, "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
