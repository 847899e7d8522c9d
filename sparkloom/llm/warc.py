"""WARC archives in seekable Zstandard bundles: independent frames of records, a seek table, and record places inside frames."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, with_columns

#: Bytes of records from which on a frame is closed, and compressed bytes from which on a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
#: Bytes that one repeated payload takes in a broadcast table, and the size up to which that table is broadcast.
KEY_BYTES, BROADCAST_BYTES = 96, 64 << 20
#: Fixed values of the Zstandard seekable format: the skippable frame's magic number, the footer's, and the flag of checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PLACE = "struct<record_id:string,page_id:long,frame:int,offset:long,length:long>"
BUNDLES = f"part int, seq int, places array<{PLACE}>, bundle binary"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
ARROW_RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

CONTROL = re.compile("[\x00-\x20\x7f]")
RECORD_ID = re.compile(r"<urn:x-page:(-?\d*):([A-Z2-7]+)>")


class Damaged(ValueError):
    """A bundle, frame or record that isn't what its sums or lengths say."""


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with ``record_type`` (response or revisit) and ``refers_to``.

    Of the rows whose payload has the same bytes, and at least ``least_bytes`` of them, the row with the largest id is the
    response and the others revisit it; all smaller payloads are responses. A null payload is empty. Rows that repeat
    the largest id are responses too; a null id never wins against another one. Payloads are compared by SHA-256.
    The table of repeated payloads is broadcast while it takes at most ``broadcast_bytes``; beyond it rows meet it in a
    shuffle join, in which unrepeated payloads have keys of their own and a hot one is split by adaptive execution.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = with_columns(pages, {"__sha": F.when(F.length(payload) >= least_bytes, F.sha2(payload, 256))})
    groups = checkpoint(keyed.where("__sha is not null").groupBy("__sha").agg(F.max(id_col).alias("__keep"), F.count("*").alias("__n")).where("__n > 1").select("__sha", "__keep"))
    groups = F.broadcast(groups) if groups.count() * KEY_BYTES <= broadcast_bytes else groups.hint("merge")
    marked = keyed.join(groups.withColumnRenamed("__sha", "__of"), F.col("__sha") == F.col("__of"), "left")
    revisit = F.col("__of").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__keep"))
    return with_columns(marked, {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("__keep"))}).drop("__sha", "__of", "__keep")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """(record id, record). A revisit has the HTTP head of its page, with the payload's length, and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = record_id(page_id, digest)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    fields.append(("Content-Length", str(len(block))))
    lines = "\r\n".join(["WARC/1.1", *[f"{k}: {v}" for k, v in fields]])
    return own, b"".join([lines.encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at a byte of a frame, as a row of RECORDS, and where the next one begins."""
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if end < 0 or lines[0] != "WARC/1.1":
        raise Damaged("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start, length = end + 4, int(fields["Content-Length"])
    body = data.find(b"\r\n\r\n", start) + 4
    stop = start + length
    if data[stop : stop + 4] != b"\r\n\r\n" or not start < body <= stop:
        raise Damaged("a record is cut off")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", data[start:body])[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = data[body:stop] if kind == "response" else None
    if payload is not None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise Damaged("a payload doesn't have its digest")
    page_of = lambda urn: int(m[1]) if (m := RECORD_ID.fullmatch(urn)) and m[1] else None
    own = fields["WARC-Record-ID"]
    refers = page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return {"record_id": own, "page_id": page_of(own), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": refers, "payload_bytes": size, "payload_digest": digest, "payload": payload}, stop + 4


class BundleWriter:
    """One bundle: frames that decompress alone, then the seek table in a skippable frame, which any Zstandard reader passes over."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int, int]] = []
        self.places: list[dict] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0

    def add(self, own: str, page_id: int | None, record: bytes) -> None:
        if self.open and self.filled + len(record) > self.frame_bytes:
            self.close_frame()
        self.places.append({"record_id": own, "page_id": page_id, "frame": len(self.frames), "offset": self.filled, "length": len(record)})
        self.open.append(record)
        self.filled += len(record)

    def close_frame(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            packed = self.packer.compress(plain)
            self.frames.append(packed)
            self.sizes.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.size += len(packed)
            self.open, self.filled = [], 0

    def close(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<III", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), CHECKSUMS, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table])


class BundleReader:
    """Frames of a bundle by number, found by the seek table at its end."""

    def __init__(self, bundle: bytes):
        self.bundle, self.unpacker = bundle, zstandard.ZstdDecompressor()
        if len(bundle) < 17:
            raise Damaged("no seek table")
        n, flags, magic = struct.unpack("<IBI", bundle[-9:])
        start = len(bundle) - 9 - 12 * n
        if magic != SEEKABLE or flags != CHECKSUMS or start < 8 or struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE, 12 * n + 9):
            raise Damaged("no seek table")
        self.sizes = list(struct.iter_unpack("<III", bundle[start : start + 12 * n]))
        self.starts, at = [], 0
        for packed, _, _ in self.sizes:
            self.starts.append(at)
            at += packed
        if at != start - 8:
            raise Damaged("the seek table doesn't fit the frames")

    def frame(self, k: int) -> bytes:
        packed, size, check = self.sizes[k]
        try:
            plain = self.unpacker.decompress(memoryview(self.bundle)[self.starts[k] : self.starts[k] + packed], max_output_size=size)
        except zstandard.ZstdError as e:
            raise Damaged(str(e)) from e
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise Damaged("a frame doesn't have its checksum")
        return plain

    def records(self) -> Iterator[dict]:
        for k in range(len(self.sizes)):
            plain, at = self.frame(k), 0
            while at < len(plain):
                found, at = parse_record(plain, at)
                yield found


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> None:
    """Write rows of mark_revisits() as WARC records into bundles, which are rows of Parquet files: (part, seq, places, bundle).

    Spark's committer writes them to any store, and a lost task is written anew. ``bundle`` by itself is a .warc.zst file
    with a seek table. ``places`` maps each record's id to its frame and to its place inside the decompressed frame. A task
    holds one open frame and one bundle at a time; a record larger than a frame has one of its own.
    A null payload is empty, a null url has no target field, control characters and spaces of a url are percent-encoded,
    and a null id leaves its place in the record's id empty. Rows equal in id and payload get the same record id.
    """

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("places", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))), ("bundle", pa.binary())])
        out = BundleWriter(frame_bytes, level)

        def closed() -> pa.RecordBatch:
            data = out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "places": out.places, "bundle": data}], schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for page_id, url, payload, kind, refers in zip(*[c.to_pylist() for c in batch.slice(lo, 64).columns], strict=True):
                    own, record = record_bytes(page_id, url, payload, kind, refers, date)
                    out.add(own, page_id, record)
                    if out.size >= bundle_bytes:
                        yield closed()
                        out, seq = BundleWriter(frame_bytes, level), seq + 1
        if out.places:
            yield closed()

    columns = [F.col(id_col).cast("long"), F.col(url_col), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"), F.col("record_type"), F.col("refers_to")]
    pages.select(*columns).mapInArrow(bundles, BUNDLES).write.parquet(path)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).parquet(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles under a path, frame by frame. Checksums, digests and lengths are checked; what fails raises Damaged.

    ``payload`` is null for revisits, and for all records without ``payloads``.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0):
                held, size = [], 0
                for found in BundleReader(bundle.as_py()).records():
                    if not payloads:
                        found["payload"] = None
                    held.append(found)
                    size += len(found["payload"] or b"") + 300
                    if size > FRAME_BYTES * 4:
                        yield pa.RecordBatch.from_pylist(held, ARROW_RECORDS)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, ARROW_RECORDS)

    return _bundles(spark, path).select("bundle").mapInArrow(records, RECORDS)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, part, seq, frame, offset, length) of every record; reads no bundle."""
    return _bundles(spark, path).select("part", "seq", F.explode("places").alias("p")).select("p.record_id", "p.page_id", "part", "seq", "p.frame", "p.offset", "p.length")


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records whose ids stand in the column record_id of ``wanted``; only the frames that hold them are decompressed.

    The places asked for meet their bundle, which holds a bounded number of them. An id that was written several times
    gives as many records; one that isn't there gives none.
    """
    places = record_index(spark, path).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    asked = places.groupBy("part", "seq").agg(F.sort_array(F.collect_list(F.struct("frame", "offset"))).alias("asked"))
    met = _bundles(spark, path).select("part", "seq", "bundle").join(asked, ["part", "seq"]).select("bundle", "asked")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                reader, last, plain = BundleReader(batch.column(0)[k].as_py()), -1, b""
                for at in batch.column(1)[k].as_py():
                    if at["frame"] != last:
                        last, plain = at["frame"], reader.frame(at["frame"])
                    yield pa.RecordBatch.from_pylist([parse_record(plain, at["offset"])[0]], ARROW_RECORDS)

    return met.mapInArrow(records, RECORDS)
