"""WARC archives as seekable Zstandard bundles, with an index of records and random access.

Writing. Records whose payloads are equal (SHA-1 and length) are found by one aggregate of digests; the one with the smallest id
is a `response`, the others are `revisit` records without payload that name it. A task writes its records one after another into bundles: records
are gathered into frames of about ``frame_bytes``, each frame is compressed on its own, and a bundle ends with
a seek table in a skippable frame (per frame the compressed and the plain size, then the number of frames, a descriptor byte and
the magic number of the seekable format), so any Zstandard reader can read the whole file and a seekable reader any part of it. At
``bundle_bytes`` a new bundle begins. A task holds one frame in memory, or one record where that is longer.

The write gives an index row a record: its identifier, bundle, frame, and offset and length within the plain frame. Bundles get names of their own in each
attempt, and the stored index names only those of attempts that succeeded; files of lost attempts are never read.

Reading. All records: bundles' seek tables become one row a frame, frames are dealt over the tasks, each frame is read by its byte range,
decompressed and cut into records. Some records: the index rows asked for are dealt by frame, and a record is cut out at its offset.

Files are opened with pyarrow's file systems (file, hdfs, s3, gs) under ``spark.checkpoint.dir`` unless ``path`` says otherwise; all
executors must reach that folder.

Nulls: a null payload counts as empty; a null url as `about:blank`; control characters, blanks and non-ASCII characters of a url are percent-encoded; a null id never is
the smallest one, and records of equal payloads that all have null ids are all responses. Repeated rows: records alike in id and payload are
each written, of the same type, under one identifier. Long payloads have a frame of their own. An empty table makes no bundle and
an empty result. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import col, stored

#: Magic numbers of the skippable frame that holds the seek table, and of its footer (fixed values of the format).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOTER, _HEADER = struct.Struct("<II"), struct.Struct("<IBI"), struct.Struct("<II")
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"
RECORD = "record_id string, key string, record_type string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def record_id(key: str | None, digest: str) -> str:
    """Identifier of the record of an id and a payload digest."""
    return f"<urn:x-page:{'-' if key is None else quote(key, safe='')}:{digest}>"


def key_of(identifier: str) -> str | None:
    """The id in a record identifier."""
    key = identifier.split(":")[2]
    return None if key == "-" else unquote(key)


def encode(key: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """One record; ``first``: the id of the response that it revisits."""
    uri = quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    block = _HTTP % len(payload)
    if first is None:
        block += payload
    else:
        # a revisit's block is the HTTP header, whose Content-Length is the full payload's
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first, digest))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def decode(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at a byte, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"no record at byte {at}: {version!r}")
    head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    begin, size = end + 4, int(head["content-length"])
    if data[begin + size:begin + size + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} doesn't end after its {size} bytes")
    block = data[begin:begin + size]
    http = block.index(b"\r\n\r\n") + 4
    full = int(re.search(rb"\r\ncontent-length: *(\d+)", block[:http].lower())[1])
    plain, identifier, refers = block[http:], head["warc-record-id"], head.get("warc-refers-to")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    return {"record_id": identifier, "key": key_of(identifier), "record_type": head["warc-type"], "refers_to": key_of(refers) if refers else None,
            "target_uri": head["warc-target-uri"], "payload_bytes": full, "payload_digest": digest, "payload": plain if refers is None else None}, begin + size + 4


class BundleWriter:
    """Writes records of one task into bundles under a folder."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.out, self.frame, self.size = None, [], 0

    def add(self, identifier: str, record: bytes) -> tuple[str, str, int, int, int]:
        """Index row of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._end_frame()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            system, path = opened(f"{self.folder}/{self.name}")
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out, self.frames, self.written = system.open_output_stream(path, compression=None), [], 0
        row = (identifier, self.name, len(self.frames), self.size, len(record))
        self.frame.append(record)
        self.size += len(record)
        return row

    def _end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.frame))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.frame, self.size = [], 0
        if self.written >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        if self.size:
            self._end_frame()
        if self.out is not None:
            table = b"".join(_ENTRY.pack(*f) for f in self.frames) + _FOOTER.pack(len(self.frames), 0, SEEKABLE)
            self.out.write(_HEADER.pack(SKIPPABLE, len(table)) + table)
            self.out.close()
            self.out = None


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of a bundle, from its footer."""
    system, inside = opened(path)
    with system.open_input_file(inside) as f:
        end = f.size()
        f.seek(end - _FOOTER.size)
        frames, descriptor, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = _ENTRY.size + (4 if descriptor & 0x80 else 0)  # with or without a checksum a frame
        f.seek(end - _FOOTER.size - entry * frames)
        table = f.read(entry * frames)
    out, at = [], 0
    for k in range(frames):
        packed, plain = _ENTRY.unpack_from(table, entry * k)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(path: str, offset: int, packed: int, plain: int) -> bytes:
    """One frame's records."""
    system, inside = opened(path)
    with system.open_input_file(inside) as f:
        f.seek(offset)
        return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_INDEX = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([("record_id", pa.string()), ("key", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
                  date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> tuple[str, DataFrame]:
    """Writes the archive; its folder and the stored index (record_id, bundle, frame, offset, length).

    Payloads of less than ``min_bytes`` are all responses. ``date`` is the records' WARC-Date; the table has none.
    """
    spark = pages.sparkSession
    folder = path or scratch_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    raw = col(payload_col).cast("binary")
    rows = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"), F.coalesce(raw, F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # only digests that occur twice go back to the records
    firsts = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = rows.join(firsts, ["digest", "size"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    marked = marked.select(F.col("id").cast("string").alias("key"), "url", "payload", "digest", F.when(revisits, F.col("first").cast("string")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes, level)
        for batch in batches:
            out = []
            for key, url, payload, digest, first in zip(*[c.to_pylist() for c in batch.columns]):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(writer.add(record_id(key, name), encode(key, url, payload, name, first, date)))
            yield _batch([dict(zip(_INDEX.names, r)) for r in out], _INDEX)
        writer.close()
    return folder, stored(marked.mapInArrow(write, INDEX))


def frames(index: DataFrame, folder: str) -> DataFrame:
    """(bundle, frame, offset, packed, plain): the seek tables of an archive's bundles, one row a frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                table = seek_table(f"{folder}/{bundle}")
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * len(table)), pa.array(range(len(table)), pa.int32()), *[pa.array([t[k] for t in table], pa.int64()) for k in range(3)]],
                                                 names=["bundle", "frame", "offset", "packed", "plain"])
    return index.select("bundle").distinct().mapInArrow(run, "bundle string, frame int, offset bigint, packed bigint, plain bigint")


def read_archive(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of an archive (see RECORD); a response's digest is held against its payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, offset, packed, plain in zip(*[batch.column(c).to_pylist() for c in ("bundle", "offset", "packed", "plain")]):
                data, at, out = read_frame(f"{folder}/{bundle}", offset, packed, plain), 0, []
                while at < len(data):
                    record, at = decode(data, at)
                    out.append(_checked(record, payloads))
                yield _batch(out, _RECORD)
    spark = index.sparkSession
    # one row a frame is little; frames are some ms of work each, so they are dealt out before they are read
    dealt = frames(index, folder).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle", "frame")
    return dealt.mapInArrow(run, RECORD)


def lookup(index: DataFrame, folder: str, identifiers: DataFrame) -> DataFrame:
    """The records of some identifiers (a table with a column record_id): only their frames are read, each once a task."""
    asked = index.join(identifiers.select("record_id").distinct(), "record_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, at, data = {}, None, b""
        for batch in batches:
            out = []
            for bundle, frame, offset, length in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")]):
                if bundle not in tables:
                    tables = {bundle: seek_table(f"{folder}/{bundle}")}
                if at != (bundle, frame):
                    at, data = (bundle, frame), read_frame(f"{folder}/{bundle}", *tables[bundle][frame])
                record, end = decode(data, offset)
                if end != offset + length:
                    raise ValueError(f"the index of {record['record_id']} doesn't fit its bundle")
                out.append(_checked(record, True))
            yield _batch(out, _RECORD)
    return asked.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORD)


def _checked(record: dict, payloads: bool) -> dict:
    if record["payload"] is not None:
        found = base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode()
        if found != record["payload_digest"] or len(record["payload"]) != record["payload_bytes"]:
            raise ValueError(f"{record['record_id']}: its payload isn't the one that was written")
    return record if payloads else record | {"payload": None}


def archived(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Writes the archive and reads it back: (id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder, index = write_archive(pages, id_col=id_col, **options)
    kind = pages.schema[id_col].dataType
    return read_archive(index, folder, payloads=False).select(F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
