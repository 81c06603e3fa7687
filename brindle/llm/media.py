"""Media columns: payloads in archives, read by a Spark data source that plans byte ranges.

`write_archives` stores payloads as 8-bit greyscale PNG images (lossless, compressed) in tar archives on shared storage; an
archive counts only once its task is done and its name is in the folder's list.  The data source `brindle_archive` lists a
folder, plans byte ranges over its archives without reading them, finds the first member of a range by its header, streams
members through Arrow in batches of some megabytes, and reads each member again by its own offset when a read or its
checksum fails; a member that keeps failing becomes a row with `error`, not a failed job, and so does a header that cannot be
read or found where one is due.

Defined results: null text counts as empty, whose payload is 64 zero bytes; repeated rows are stored each; an empty table
gives an empty folder and an empty result; texts of any length are one image of 64 pixels' width; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.llm.shared import octets, stage, table
from brindle.operators.graph import shared_dir

BLOCK = 512
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LISTED = "_archives"
MEMBERS = "archive string, offset long, name string, data binary, error string"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 128 << 20, 8 << 20, 8 << 20
#: Ranges grow beyond RANGE_BYTES so that a folder has about this many at most, the archives' own number aside.
RANGES = 50_000
#: Bytes asked for at once while members are read one after the other.
WINDOW_BYTES = 1 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path: the local one, or any that Arrow knows by URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would use for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


# Stored form


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int, level: int = 3) -> bytes:
    """8-bit greyscale, 64 pixels wide, rows unfiltered; the text's own length is a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(scan.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """Payload and the text's own length; raises ValueError on any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, n_bytes, rows, kind = 8, [], -1, 0, b""
    while at < len(data):
        if len(data) - at < 12 or (size := int.from_bytes(data[at : at + 4], "big")) > len(data) - at - 12:
            raise ValueError(f"a chunk at {at} runs over the end")
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if int.from_bytes(data[at + 8 + size : at + 12 + size], "big") != zlib.crc32(kind + part):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            rows = int.from_bytes(part[4:8], "big")
        elif kind == b"tEXt":
            n_bytes = int(part.partition(b"\0")[2])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if kind != b"IEND":
        raise ValueError("no end chunk")
    try:
        scan = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if not rows or scan.size != rows * (WIDTH + 1) or not 0 <= n_bytes <= rows * WIDTH:
        raise ValueError(f"{scan.size} bytes and a length of {n_bytes} in {rows} rows")
    return scan.reshape(rows, WIDTH + 1)[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Integer features, the same on every machine: 64-bit average hash over an 8 x 8 grid, mean (in thousandths), distinct values."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = np.linspace(0, len(pixels), 9).astype(int)
    columns = pixels.reshape(len(pixels), 8, 8).sum(axis=2, dtype=np.int64)
    grid = np.stack([columns[a:b].sum(axis=0) * 8_000 // max(1, (b - a) * 8) for a, b in zip(bands[:-1], bands[1:], strict=True)])
    bits = (grid.ravel() * 64 > grid.sum()).astype(int)
    total = int(columns.sum())
    return f"{int(''.join(map(str, bits)), 2):016x}-{total * 1000 // pixels.size}-{len(np.unique(pixels))}"


# Archives


def header(name: str, size: int) -> bytes:
    fields = name.encode().ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + (b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")) + b"00000000000\0"
    rest = b"0" + bytes(100) + b"ustar\00000" + bytes(247)
    return fields + b"%06o\0 " % sum(fields + b" " * 8 + rest) + rest


def parsed(block: bytes, key: str) -> tuple[str, int] | None:
    """Name and size if the block is the header of a member of the archive with this key."""
    if len(block) < BLOCK or block[257:262] != b"ustar" or not block.startswith(key.encode()):
        return None
    try:
        if int(block[148:154], 8) != sum(block[:148]) + 32 * 8 + sum(block[156:]):
            return None
        size = int.from_bytes(block[125:136], "big") if block[124] == 0x80 else int(block[124:135], 8)
        return block[:100].rstrip(b"\0").decode(), size
    except ValueError:
        return None


def rounded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def archiver(folder: str):
    """Writes what its task is given into archives of the folder; yields their names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), octets(batch.column("text")), strict=True):
                if out is None:
                    name, size = uuid.uuid4().hex, 0
                    out = store.open_output_stream(f"{root}/{name}.tar")
                data = to_png(padded(text), len(text))
                out.write(header(f"{name}/{'null' if doc_id is None else doc_id}.png", len(data)) + data + bytes(rounded(len(data)) - len(data)))
                size += BLOCK + rounded(len(data))
                if size >= ARCHIVE_BYTES:
                    out.write(bytes(2 * BLOCK))
                    out.close()
                    done, out = [*done, name], None
        if out is not None:
            out.write(bytes(2 * BLOCK))
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    return write


def write_archives(docs: DataFrame) -> str:
    """Store all texts; returns the folder.  Only archives of finished tasks are listed, so retried tasks leave no doubles.

    The list has a name for each archive of up to 128 MB, like the file listing that any Spark scan keeps on the driver.
    """
    spark = docs.sparkSession
    folder = qualified(spark, f"{shared_dir(spark)}/media-{uuid.uuid4().hex}")
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [r["archive"] for r in stage(rows.mapInArrow(archiver(folder), "archive string"), "media-list").collect()]
    with store.open_output_stream(f"{root}/{LISTED}") as out:
        out.write("\n".join(sorted(names)).encode())
    return folder


# Data source


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int, total: int):
        self.archive, self.start, self.end, self.total = archive, start, end, total


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Range]:
        store, root = filesystem(self.folder)
        with store.open_input_stream(f"{root}/{LISTED}") as names:
            listed = {f"{x}.tar" for x in names.read().decode().split("\n") if x}
        files = [x for x in store.get_file_info(fs.FileSelector(root)) if x.base_name in listed]
        if len(files) != len(listed):
            raise FileNotFoundError(f"{len(listed) - len(files)} listed archives are missing in {self.folder}")
        step = rounded(max(self.range_bytes, sum(x.size for x in files) // RANGES))
        return [Range(x.base_name, at, min(at + step, x.size), x.size) for x in sorted(files, key=lambda x: x.base_name) for at in range(0, x.size, step)] or [Range("", 0, 0, 0)]

    def attempt(self, path: str, start: int, size: int) -> bytes:
        """Bytes at an offset, by a new handle for each try."""
        for left in range(self.retries, -1, -1):
            try:
                store, root = filesystem(self.folder)
                with store.open_input_file(f"{root}/{path}") as source:
                    data = source.read_at(size, start)
                if len(data) == size:
                    return data
                raise OSError(f"{len(data)} of {size} bytes at {start}")
            except OSError:
                if not left:
                    raise
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Members whose header is in the range.  Damage is a row with `error`: of the member, or of an unreadable header.

        The member after the last of a range may have lost its header too; the range before it is the one that knows its place.
        """
        if not partition.archive:
            return
        key = partition.archive.removesuffix(".tar") + "/"
        window, window_at = b"", 0

        def piece(at: int, size: int) -> bytes:
            nonlocal window, window_at
            if at < window_at or at + size > window_at + len(window):
                window, window_at = b"", at
                window = self.attempt(partition.archive, at, min(max(size, WINDOW_BYTES), partition.total - at))
            return window[at - window_at : at - window_at + size]

        rows, held, at, in_step = [], 0, rounded(partition.start), partition.start == 0
        while at < partition.end or (in_step and at < partition.total):
            block, found, error = b"", None, "no header"
            try:
                block = piece(at, min(BLOCK, partition.total - at))
                found = parsed(block, key)
            except OSError as e:
                error, in_step = str(e), True
            if found is None or at >= partition.end:
                if in_step and found is None and block.strip(b"\0") or not block:
                    rows.append((partition.archive, at, None, None, f"{error} at {at}"))
                if at >= partition.end or not block:
                    break
                # Inside a member that began in the range before, after damage, or the archive's end.
                in_step, at = False, at + BLOCK
                continue
            name, size = found
            data, error = None, None
            try:
                data = piece(at + BLOCK, size)
                from_png(data)
            except (OSError, ValueError):
                try:
                    data = self.attempt(partition.archive, at + BLOCK, size)
                    from_png(data)
                except (OSError, ValueError) as e:
                    data, error = None, str(e)
            rows.append((partition.archive, at, name.removeprefix(key), data, error))
            held += size
            in_step, at = True, at + BLOCK + rounded(size)
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "data", "error"])


class ArchiveSource(DataSource):
    """spark.read.format("brindle_archive").load(folder); options rangeBytes and retries."""

    @classmethod
    def name(cls) -> str:
        return "brindle_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("brindle_archive").load(folder)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and checksums of stored members, from the bytes read back."""
    for batch in batches:
        rows = []
        for name, data, error in zip(*(batch.column(x).to_pylist() for x in ("name", "data", "error")), strict=True):
            doc_id = None if name in (None, "null.png") else int(name.removesuffix(".png"))
            try:
                payload, n_bytes = from_png(data or b"")
            except ValueError as e:
                rows.append((doc_id, None, None, None, None, None, None, None, error or str(e)))
                continue
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload), None))
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(table(spark, sf_dir, "documents"))
    return read_archives(spark, folder).select("name", "data", "error").mapInArrow(digest, DIGEST)


QUERIES = {"op5_media_columns": op5_media_columns}
ORACLE_SQL: dict[str, str] = {}
