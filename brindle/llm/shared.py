"""What the corpus operators share: reading, staging on shared storage, compact binary columns and blocks of documents.

Blocks
------
Several operators have to ask a corpus-wide question about every n-gram or byte window of every text.  Shuffling one row
per occurrence costs tens of bytes each.  Instead documents are packed into *blocks* (some megabytes of text, one row each,
written once to shared storage, so that a block's id and content never change).  A block sends its sorted distinct 64-bit
keys, cut by key range into *buckets*, delta-coded and compressed; the task of a bucket merges what all blocks sent and
answers each block with one short payload in the order of the block's own keys.  Both sides are derived again from the
staged block whenever a task is lost, so nothing depends on executor-local state.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.graph import written

CODEC = "zstd"
#: The C library's way to give back free pages, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB for this session: buffers between the JVM and Python then stay small for long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits, unit = now.rstrip("bBkKmMgG"), now.lower().rstrip("b")[-1:]
    if not digits.isdigit() or int(digits) * units.get(unit, 1) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stage(df: DataFrame, name: str, compression: str = CODEC) -> DataFrame:
    """Write a DataFrame as a table on shared storage and read it back: cuts lineage and fixes row content.

    Tables of already compressed columns are written without compression; `discard` deletes a table after its last reader.
    """
    bounded_batches(df.sparkSession)
    return written(df, name, compression)


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task with what they hold, and several may be alive."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeeze(data: bytes | np.ndarray) -> bytes:
    """Compressed bytes, with the raw length in front."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, CODEC, asbytes=True) if raw else b""


def expand(data: bytes) -> bytes:
    if not data:
        return b""
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), CODEC, asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane (high planes are mostly equal), compressed."""
    if not len(values):
        return b""
    width = 8 if int(values.max()) >> 32 else 4
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + squeeze(planes)


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(expand(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Non-decreasing uint64 values as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0))) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and odd multipliers), so that any bits of the result are usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from one equal key range to the next; buckets + 1 positions."""
    step = (1 << 64) // buckets
    starts = np.array([step * i for i in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def runs(same_as_before: np.ndarray) -> np.ndarray:
    """Start positions of runs, from a mask that says whether an element continues the one before it."""
    return np.flatnonzero(~same_as_before)


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def with_checksum(docs: DataFrame, modulus: int, column: str = "doc_id"):
    """crc32(doc_id as text) mod modulus as a column expression."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def as_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def require(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator uses, so that extra columns can neither clash nor be read."""
    return docs.select(*columns)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Marked for broadcast if it has at most `rows` narrow rows, else left to a shuffled join; `df` is a staged table."""
    return F.broadcast(df) if df.count() <= rows else df


def identity() -> Column:
    """doc_id, or for rows without one a number from the text, larger than usual ids."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit("text")).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
