"""WARC archives in seekable Zstandard bundles, as a Spark data source.

A bundle is a file of independent Zstandard frames, each with whole WARC records of about a megabyte, and a
skippable frame with the seek table at its end (compressed size, size and checksum of every frame), as the
seekable format lays it down. Any Zstandard tool reads a bundle from front to back; a reader with the seek
table decompresses single frames. Beside the bundles lies an index, a Parquet table that maps record
identifiers to bundle, frame, offset inside the frame and length.

Tasks write bundles below a temporary folder of the job and the commit moves them to their place, so a lost
executor or a repeated task leaves nothing behind. Paths are those of pyarrow's file systems and must be
shared by all executors.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from tabsmith.operators.lookup import lookup
from tabsmith.session import scratch_path

FORMAT = "warc_zst"
MIN_REVISIT_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
DATE = "1970-01-01T00:00:00Z"

# fixed values of the seekable Zstandard format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
# fixed value of the WARC standard
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"
_INDEX = pa.schema([
    ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
])
_READ = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()),
])


# --- records ------------------------------------------------------------------------------------


def _urn(identifier: str | None) -> str:
    return "<urn:record>" if identifier is None else f"<urn:record:{urllib.parse.quote(identifier, safe='')}>"


def _identifier(urn: str) -> str | None:
    return None if urn == "<urn:record>" else urllib.parse.unquote(urn[len("<urn:record:") : -1])


def _escaped(url: str) -> str:
    """Blanks and control characters cannot stand in a header line: they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(identifier, kind, url, digest, size, refers_to, payload, date=DATE) -> bytes:
    """One WARC record. A revisit carries the HTTP header only, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(identifier)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and where the next one starts; its payload is checked against its digest."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}: {lines[0][:40]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start) + 4
    http = dict(line.split(": ", 1) for line in data[start : body - 4].decode().split("\r\n")[1:])
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = data[body:stop] if kind == "response" else None
    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    refers = head.get("WARC-Refers-To")
    return {
        "record_id": _identifier(head["WARC-Record-ID"]), "record_type": kind, "url": head.get("WARC-Target-URI"),
        "payload_digest": digest, "payload_bytes": int(http["Content-Length"]),
        "refers_to": None if refers is None else _identifier(refers), "payload": payload,
    }, stop + 4


# --- bundles ------------------------------------------------------------------------------------


@dataclass
class _Bundle:
    """One open bundle: frames are written as they fill, the seek table at the end."""

    fs: pafs.FileSystem
    root: str
    name: str
    frame_bytes: int
    level: int
    frames: list[tuple[int, int, int]] = field(default_factory=list)
    index: list[tuple] = field(default_factory=list)
    size: int = 0

    def __post_init__(self):
        self.out = self.fs.open_output_stream(f"{self.root}/bundles/{self.name}", compression=None)
        self.frame = io.BytesIO()

    def add(self, identifier: str | None, record: bytes) -> None:
        self.index.append((identifier, self.name, len(self.frames), self.frame.tell(), len(record)))
        self.frame.write(record)
        if self.frame.tell() >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        data = self.frame.getvalue()
        if data:
            packed = zstandard.ZstdCompressor(level=self.level).compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.size += len(packed)
            self.frame = io.BytesIO()

    def close(self) -> str:
        self.flush()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()
        columns = [pa.array(c, t) for c, t in zip(zip(*self.index), _INDEX.types)]
        pq.write_table(pa.Table.from_arrays(columns, schema=_INDEX), f"{self.root}/index/{self.name}.parquet", filesystem=self.fs)
        return self.name


class Frames:
    """Random access to the frames of one bundle by its seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"no seek table in {path}")
        entries = self._read(size - 9 - 12 * count, 12 * count)
        self.entries = list(struct.iter_unpack("<III", entries))
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.entries)

    def __getitem__(self, i: int) -> bytes:
        packed, size, check = self.entries[i]
        data = zstandard.ZstdDecompressor().decompress(self._read(self.starts[i], packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        return data

    def close(self) -> None:
        self.file.close()


# --- the data source ----------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.fs_path = options["path"]
        self.job = f"_temporary/{uuid.uuid4().hex}"
        self.frame_bytes = int(options.get("frame_bytes", FRAME_BYTES))
        self.bundle_bytes = int(options.get("bundle_bytes", BUNDLE_BYTES))
        self.level = int(options.get("level", LEVEL))
        self.date = options.get("date", DATE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = pafs.FileSystem.from_uri(self.fs_path)
        made, names, bundle = f"{root}/{self.job}", [], None
        for folder in ("bundles", "index"):
            fs.create_dir(f"{made}/{folder}")
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in _READ.names)):
                if bundle is None:
                    bundle = _Bundle(fs, made, f"{uuid.uuid4().hex}.warc.zst", self.frame_bytes, self.level)
                bundle.add(row[0], record_bytes(*row, self.date))
                if bundle.size >= self.bundle_bytes:
                    names.append(bundle.close())
                    bundle = None
        if bundle is not None:
            names.append(bundle.close())
        return _Written(names)

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.fs_path)
        for folder in ("bundles", "index"):
            fs.create_dir(f"{root}/{folder}")
        names = [name for m in messages if m is not None for name in m.names]
        for name in names:
            fs.move(f"{root}/{self.job}/bundles/{name}", f"{root}/bundles/{name}")
            fs.move(f"{root}/{self.job}/index/{name}.parquet", f"{root}/index/{name}.parquet")
        if not names:
            pq.write_table(_INDEX.empty_table(), f"{root}/index/empty-{uuid.uuid4().hex}.parquet", filesystem=fs)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.fs_path)
        if fs.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class _Reader(DataSourceReader):
    """One partition per bundle; bundles are bounded in size."""

    def __init__(self, options: dict[str, str]):
        self.fs_path, self.payload = options["path"], options.get("payload", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.fs_path)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/bundles", allow_not_found=False))
        return [InputPartition(f.path) for f in found if f.path.endswith(".warc.zst")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.fs_path)
        frames = Frames(fs, partition.value)
        for i in range(len(frames)):
            data, at, rows = frames[i], 0, []
            while at < len(data):
                row, at = parse_record(data, at)
                rows.append(row if self.payload else {**row, "payload": None})
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
        frames.close()


class WarcSource(DataSource):
    """``spark.read.format("warc_zst")`` and ``df.write.format("warc_zst").mode("append")``.

    Options: path, and for writing frame_bytes, bundle_bytes, level, date; ``payload=false`` reads without payloads.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("bundles are only appended")
        return _Writer(dict(self.options))


# --- pages --------------------------------------------------------------------------------------


def page_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The records of ``pages(page_id, url, html)``, one a row, with the columns of the data source.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``min_revisit_bytes`` the
    rows with the largest page_id are responses and the others revisit it; shorter payloads are all
    responses. Repeated rows are records of their own and get the same type. A null page_id is smaller than
    any other. Other columns are not read. Payloads are equal where their SHA-256 is; of the repeated ones
    the page_ids are looked up, broadcast only where measured to be small, else by a salted join.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("string").alias("record_id"), F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    size = F.octet_length("payload")
    key = F.when(size >= min_revisit_bytes, F.sha2("payload", 256))
    path = scratch_path(spark, "repeated-payloads")
    again = rows.select(key.alias("payload_key"), "page_id").where("payload_key IS NOT NULL")
    again = again.groupBy("payload_key").agg(F.count("*").alias("n"), F.max("page_id").alias("leader")).where("n > 1")
    again.select("payload_key", F.col("leader").cast("string").alias("leader")).write.parquet(path)
    rows = lookup(rows, spark.read.parquet(path), key, "payload_key", "leader")
    revisit = F.col("leader").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("leader"))
    return rows.select(
        "record_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "url",
        F.sha1("payload").alias("payload_digest"), size.cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("leader")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str, **options) -> None:
    """Append records to the archive at ``path``."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format(FORMAT).options(**options).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of an archive; an archive without records gives an empty table."""
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, bundle, frame, offset, length) of every record."""
    return spark.read.parquet(f"{path}/index")


def _fetched(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        name = frames = number = data = None
        for batch in batches:
            rows = []
            for bundle, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset"))):
                if bundle != name:
                    if frames is not None:
                        frames.close()
                    frames, name, number = Frames(fs, f"{root}/bundles/{bundle}"), bundle, None
                if frame != number:
                    data, number = frames[frame], frame
                rows.append(parse_record(data, offset)[0])
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


def fetch(spark: SparkSession, path: str, identifiers: DataFrame) -> DataFrame:
    """The records named in ``identifiers(record_id)``, by index and seek table: only their frames are decompressed."""
    wanted = identifiers.select(F.col("record_id").cast("string").alias("record_id")).distinct()
    places = read_index(spark, path).join(wanted, "record_id").select("bundle", "frame", "offset")
    return places.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_fetched(path), RECORD)


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` to an archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind: T.DataType = pages.schema["page_id"].dataType
    write_archive(page_records(pages), path)
    back = read_archive(pages.sparkSession, path, payload=False)
    return back.select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
