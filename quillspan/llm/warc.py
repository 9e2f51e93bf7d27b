"""Web archives: WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame with
a seek table ends each bundle.  An index maps record identifiers to bundle, frame and
offset within the frame, so one record can be read without the rest of its bundle.

Tasks write bundles under names of their own to the shared folder and report index
rows; Spark commits those rows, and only bundles in the committed index are ever
read, so a repeated or lost task leaves at most unread files.

Reading goes the same way round: the index's rows are dealt by ranges of frames, to a
number of tasks that follows from the bytes they point to; a task opens each of its
frames once and takes the records at the index's offsets, which have to hold the
record that the index names.

Edge cases: a null payload is empty; of equal payloads of at least MIN_REVISIT bytes
those with the largest page_id are responses (several if rows are repeated) and the
others revisits; null ids count as smallest; an empty table gives no bundles and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, pieces_of, shared_dir

MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
#: Frames that one task reads together, and bytes of records that a task is meant to read.
FRAMES, READ_BYTES = 16, 64 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_INDEX = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string())])


def open_shared(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of the shared folder (local mounts, HDFS and object stores alike)."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record; a revisit has no block, but says its payload's digest and length and which record holds it."""
    block = b"" if is_revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {''.join(url.split())}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record in a frame; raises ValueError if the bytes aren't records."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("truncated record")
        yield fields, data[start:stop]
        at = stop + 4


class BundleWriter:
    """Writes one bundle to a stream."""

    def __init__(self, out):
        self.out, self.frames, self.buffer, self.filled, self.written = out, [], [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and size of the record."""
        place = len(self.frames), self.filled, len(record)
        self.buffer.append(record)
        self.filled += len(record)
        if self.filled >= FRAME_BYTES:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.buffer:
            packed = self.packer.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.filled))
            self.written += len(packed)
            self.buffer, self.filled = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads frames of a bundle by way of its seek table."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        table = source.read(8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.frames[n]
        self.source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if len(data) != plain:
            raise ValueError("frame of a wrong size")
        return data


def open_bundle(uri: str) -> BundleReader:
    system, path = open_shared(uri)
    return BundleReader(system.open_input_file(path), system.get_file_info(path).size)


def read_record(bundle: str, frame: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record, by its row of the index."""
    return next(parse_records(open_bundle(bundle).frame(frame)[at : at + size]))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its SHA-1, and for revisits refers_to and is_revisit.

    Digests are counted before the shuffle; only those of several pages are joined
    back.  Payloads too short to be revisits have no part in that join, and a digest
    that many pages share is no single task's (see ``attach``).
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("shared", F.when(F.octet_length("payload") >= MIN_REVISIT, F.col("digest")))
    shared = materialize(rows.where("shared IS NOT NULL").groupBy("shared").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id")).where("n > 1"), "digests")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return attach(rows, shared, "shared", "n").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("is_revisit"))


def write_bundles(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the planned records to bundles below ``folder`` and returns the committed index."""

    def run(batches):
        system, path = open_shared(folder)
        system.create_dir(path, recursive=True)
        writer, name, rows = None, "", []
        for batch in pieces_of(batches, 2, 8 << 20):
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{path}/{name}", compression=None))
                rows.append((record_id(values[0]), f"{folder}/{name}", *writer.add(format_record(*values))))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
            rows = []
        if writer is not None:
            writer.close()

    return materialize(planned.select("page_id", "url", "payload", "digest", "refers_to", "is_revisit").mapInArrow(run, "record_id string, bundle string, frame long, at long, size long"), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the index, read back from its place in the archives and checked against its digest."""

    def run(batches):
        name, number, reader, plain = None, None, None, b""
        for batch in batches:
            rows = []
            for rid, bundle, frame, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    name, number, reader = bundle, None, open_bundle(bundle)
                if frame != number:
                    number, plain = frame, reader.frame(frame)
                fields, block = next(parse_records(plain[at : at + size]))
                if fields["WARC-Record-ID"] != rid:
                    raise ValueError(f"{fields['WARC-Record-ID']} stands where the index has {rid}, in {bundle}")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"damaged record {rid} in {bundle}")
                page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                rows.append((int(page) if page else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], int(refers) if refers else None, rid, bundle))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    spark = index.sparkSession
    n_bytes = index.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_bytes // READ_BYTES))
    group = F.floor(F.col("frame") / FRAMES)
    dealt = index.select("record_id", "bundle", "frame", "at", "size").repartition(tasks, "bundle", group).sortWithinPartitions("bundle", "frame", "at")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string")


def archive(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what reading those back gives."""
    index = write_bundles(plan_records(pages), shared_dir(pages.sparkSession, "warc"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
