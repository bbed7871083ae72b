"""Media columns (operator 1): payloads in archives, read through a custom Spark data source.

A media column's bytes lie in ZIP archives in a directory that all executors see; the table has a
reference to each.  The data source ``archive_members`` plans by byte range: the driver lists the
archives and their sizes and cuts them into ranges, without opening any.  A task reads its archive's
central directory from the end of the file, takes the members whose headers begin in its range, and
streams their payloads as Arrow batches of bounded bytes.  A member that can't be read or fails its
checksum is tried again alone, by its offset, and after the last try comes out as a row with an
error and no payload; its neighbours are not affected.

``write_archives`` makes such archives from a table: each task writes archives under names no other
attempt uses, and the manifest, written when all tasks are done, names those that count, so that
what a lost executor left behind is not read.

Defined cases: a null payload has no member and gives no row; an empty payload is a member of 0
bytes; payloads of any length below the limit of a Spark value (2 GB) are read whole; members with
equal names, or archives with equal contents, are all read; a directory without archives is an
empty table; a member that ends in ``/`` and has no bytes is a folder and gives no row; ids are
percent-encoded in member names (up to 65,535 bytes), so that none looks like a folder or is cut; an
archive whose directory can't be read is tried again as members are, and then is one row with an error.
"""

from __future__ import annotations

import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.llm import common as c

ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, BLOCK_BYTES = 64 << 20, 16 << 20, 4 << 20, 1 << 20
RETRIES = 3
SCHEMA = "archive string, member string, header_offset bigint, n_bytes bigint, media_type string, attempts int, error string, payload binary"
_NAMES = ["archive", "member", "header_offset", "n_bytes", "media_type", "attempts", "error", "payload"]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()]
_MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"%PDF-", "application/pdf"),
    (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"), (b"ID3", "audio/mpeg"), (b"\x1aE\xdf\xa3", "video/webm"), (b"PK\x03\x04", "application/zip"),
)


def media_type(payload: bytes) -> str:
    """By the first bytes; UTF-8 is text."""
    for magic, kind in _MAGIC:
        if payload.startswith(magic):
            return kind
    if payload[:4] == b"RIFF":
        return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(payload[8:12], "application/octet-stream")
    if payload[4:8] == b"ftyp":
        return "video/mp4"
    try:
        payload.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    return "text/html" if payload[:256].lstrip().lower().startswith((b"<!doctype html", b"<html")) else "text/plain"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class Member:
    """What the central directory says of a member."""

    def __init__(self, info: zipfile.ZipInfo) -> None:
        self.name, self.offset, self.packed, self.size, self.method, self.crc = info.filename, info.header_offset, info.compress_size, info.file_size, info.compress_type, info.CRC


def read_member(file, member: Member) -> bytes:
    """The payload, from the local header at the member's offset; raises if it is damaged."""
    file.seek(member.offset)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no local header at the offset")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(member.offset + 30 + name + extra)
    data = file.read(member.packed)
    if len(data) != member.packed:
        raise ValueError("the archive ends amid the member")
    if member.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data, member.size + 1)  # no more than the directory promises
    elif member.method != zipfile.ZIP_STORED:
        raise ValueError(f"compression method {member.method}")
    if len(data) != member.size or zlib.crc32(data) != member.crc:
        raise ValueError("length or checksum differ from the directory's")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options.get("path", "")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.manifest = options.get("manifest")

    def archives(self) -> list[tuple[str, int]]:
        """Paths and sizes of all archives below ``path``, or of those in the manifest."""
        system, root = fs.FileSystem.from_uri(self.paths if "://" in self.paths else "file://" + self.paths)
        prefix = self.paths[: len(self.paths) - len(root)] if self.paths.endswith(root) else ""
        if self.manifest:
            import pyarrow.dataset as ds

            system, root = fs.FileSystem.from_uri(self.manifest)
            table = ds.dataset(root, filesystem=system, format="parquet").to_table(columns=["archive", "bytes"])
            return sorted(zip(table.column("archive").to_pylist(), table.column("bytes").to_pylist()))
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))

    def partitions(self) -> list[InputPartition]:
        return [_Range(path, at, min(at + self.range_bytes, size)) for path, size in self.archives() for at in range(0, size, self.range_bytes)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        system, path = fs.FileSystem.from_uri(partition.path if "://" in partition.path else "file://" + partition.path)

        def opened():
            return io.BufferedReader(_Seekable(system.open_input_file(path)), BLOCK_BYTES)

        for attempt in range(1, max(1, self.retries) + 1):
            try:
                with zipfile.ZipFile(opened()) as directory:
                    members = [Member(i) for i in directory.infolist() if partition.start <= i.header_offset < partition.end and not (i.is_dir() and not i.file_size)]
                break
            except (OSError, ValueError, zipfile.BadZipFile) as failure:
                broken = f"archive: {type(failure).__name__}: {failure}"
                time.sleep(0.01 * 2**attempt)
        else:
            if partition.start == 0:
                yield self._batch([(partition.path, None, None, None, None, attempt, broken, None)])
            return
        file = opened()
        rows, held = [], 0
        for member in sorted(members, key=lambda m: m.offset):
            payload = error = None
            attempt = 0
            while payload is None and attempt < max(1, self.retries):
                attempt += 1
                try:
                    payload = read_member(file, member)
                    error = None
                except (OSError, ValueError, zlib.error) as failure:
                    error = f"{type(failure).__name__}: {failure}"
                    time.sleep(0.01 * 2**attempt)
                    file = opened()
            kind = None if payload is None else media_type(payload)
            rows.append((partition.path, member.name, member.offset, member.size, kind, attempt, error, payload))
            held += member.size
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), _KINDS)], _NAMES)


class _Seekable(io.RawIOBase):
    """An Arrow file as a raw Python file."""

    def __init__(self, file) -> None:
        self._file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        base = 0 if whence == 0 else self._file.tell() if whence == 1 else self._file.size()
        if base + offset < 0:
            raise OSError("before the start of the file")
        self._file.seek(base + offset)
        return self._file.tell()

    def tell(self) -> int:
        return self._file.tell()

    def readinto(self, buffer) -> int:
        data = self._file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members")``; options path, manifest, rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(**options).load(path)


def _archive_writer(directory: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(directory)
        name = stream = archive = None
        members = held = 0

        def close() -> pa.RecordBatch:
            archive.close()
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{directory}/{name}"]), pa.array([size], pa.int64()), pa.array([members], pa.int64())], ["archive", "bytes", "members"])

        for batch in batches:
            for member, payload in zip(batch.column("member"), batch.column("payload")):
                if not payload.is_valid:
                    continue
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = system.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(_Appended(stream), "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                    members = held = 0
                data = payload.as_buffer().to_pybytes()
                archive.writestr(zipfile.ZipInfo(str(member.as_py())), data, zipfile.ZIP_DEFLATED, 1)
                members, held = members + 1, held + len(data)
                if held >= limit:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return run


class _Appended(io.RawIOBase):
    """A write-only stream that zipfile treats as one that can't seek."""

    def __init__(self, stream) -> None:
        self._stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def write_archives(df: DataFrame, member_col: str, payload_col: str, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, str]:
    """Archive the payloads; returns the directory and the manifest of the archives in it."""
    spark = df.sparkSession
    directory = c.scratch(spark, "archives")
    system, root = fs.FileSystem.from_uri(directory)
    system.create_dir(root, recursive=True)
    rows = df.select(F.col(member_col).cast("string").alias("member"), F.col(payload_col).cast("binary").alias("payload"))
    manifest = f"{directory}-manifest"
    rows.mapInArrow(_archive_writer(directory, archive_bytes), "archive string, bytes bigint, members bigint").write.parquet(manifest)
    return directory, manifest


def text_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Archive every text as UTF-8 under its id and read it back through the data source.

    ``(doc_id, media_type, n_bytes, attempts, error, sha256, text)``, one row per text that is not null.
    """
    kind = df.schema[id_col].dataType
    name = F.coalesce(F.concat(F.lit("i"), F.url_encode(F.col(id_col).cast("string"))), F.lit("n"))  # n is a null id
    directory, manifest = write_archives(df.select(name.alias("member"), F.col(text_col).cast("string").cast("binary").alias("payload")), "member", "payload")
    members = read_archives(df.sparkSession, directory, manifest=manifest)
    named = F.when(F.col("member") != "n", F.url_decode(F.substring("member", F.lit(2), F.length("member"))))
    return members.select(
        named.cast(kind).alias("doc_id"), "media_type", "n_bytes", "attempts", "error",
        F.sha2("payload", 256).alias("sha256"), F.decode("payload", "UTF-8").alias("text"),
    )
