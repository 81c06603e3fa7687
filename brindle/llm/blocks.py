"""Blocks of tokenised documents, and the exchange by which blocks ask corpus-wide questions (see `shared`)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import bucket_edges, expand, give_back, octets, pack, partitions, squeeze, stage, unpack

BLOCK_BYTES = 8 << 20
BLOCKS = "block long, n_tokens long, doc_ids array<long>, sizes array<long>, tokens binary, vocabulary binary"
ASKED = "bucket int, block long, kind int, keys binary, extra binary"
ANSWERS = "block long, bucket int, kind int, answer binary"


@dataclass
class Block:
    """Documents as numbers of words in a vocabulary of the block; words are bytes without white space."""

    block: int
    doc_ids: list[int | None]
    sizes: np.ndarray
    tokens: np.ndarray
    packed_vocabulary: bytes

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(row["block"], row["doc_ids"], np.array(row["sizes"], np.int64), unpack(row["tokens"]).astype(np.int64), row["vocabulary"])

    @property
    def words(self) -> list[bytes]:
        return expand(self.packed_vocabulary).split(b" ") if self.packed_vocabulary else []

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word of the vocabulary."""
        raw = b"".join([xxhash.xxh3_128_digest(w) for w in self.words])
        both = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
        return both[:, 0].copy(), both[:, 1].copy()

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def order_keys(self) -> np.ndarray:
        """doc_ids as unsigned numbers in the same order; null comes last."""
        return np.array([(1 << 64) - 1 if x is None else x + (1 << 63) for x in self.doc_ids], np.uint64)


def signed(keys: np.ndarray) -> np.ndarray:
    """Order keys as the ids they stand for, in the same order; the largest stands for null."""
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def blocker(lower: bool, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {}
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            row = {"block": number, "n_tokens": len(tokens), "doc_ids": doc_ids, "sizes": [len(p) for p in parts], "tokens": pack(tokens), "vocabulary": squeeze(b" ".join(known))}
            kinds = {"block": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "tokens": pa.binary(), "vocabulary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in kinds.items()], names=list(kinds))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), octets(batch.column("text")), strict=True):
                words = (text.lower() if lower else text).split()
                put = known.setdefault
                parts.append(np.fromiter([put(w, len(known)) for w in words], np.uint32, len(words)))
                doc_ids.append(doc_id)
                held += len(text) + 64
                if held >= block_bytes:
                    yield flush()
                    number, known, doc_ids, parts, held = number + 1, {}, [], [], 0
                    give_back()
        if doc_ids:
            yield flush()
        known, doc_ids, parts = {}, [], []
        give_back()

    return build


def make_blocks(docs: DataFrame, lower: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Staged blocks of all documents: words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case if asked for; null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(rows.mapInArrow(blocker(lower, block_bytes), BLOCKS), "blocks", "uncompressed")


Question = tuple[int, np.ndarray, Callable[[int, int], tuple[bytes, bytes]]]


def asked_rows(block: int, questions: list[Question], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets.  A question: its kind, sorted keys whose ranges are the buckets, and a function that packs a slice."""
    for kind, keys, packed in questions:
        edges = bucket_edges(keys, buckets)
        rows = [(b, block, kind, *packed(edges[b], edges[b + 1])) for b in range(buckets) if edges[b + 1] > edges[b]]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "kind", "keys", "extra"])


#: A bucket merges about this many keys at once, whatever the number of partitions.
BUCKET_KEYS = 4_000_000


def n_buckets(blocks: DataFrame) -> int:
    """Buckets by the tokens of staged blocks; every block sends a row to each, so they are no more than memory asks for."""
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] if "n_tokens" in blocks.columns else blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
    return max(4 * partitions(blocks.sparkSession), -(-(tokens or 0) // BUCKET_KEYS))


def ask(blocks: DataFrame, questions_of: Callable[[Block], list[Question]], merge: Callable[[int, list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """Answers (block, bucket, kind, answer): every block asks, every bucket answers all who asked it.

    `merge(kind, keys, extras)` gets what the blocks sent to one bucket and returns one answer for each, in order.
    """
    buckets = n_buckets(blocks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.of(batch.slice(row, 1).to_pylist()[0])
                yield from asked_rows(block.block, questions_of(block), buckets)
                give_back()

    return answered(blocks.mapInArrow(send, ASKED), merge)


def answered(asked: DataFrame, merge: Callable[[int, list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    def reply(rows: pa.Table) -> pa.Table:
        kinds = rows.column("kind").to_numpy()
        give_back()
        out = {"block": [], "bucket": [], "kind": [], "answer": []}
        for kind in np.unique(kinds).tolist():
            own = rows.filter(pa.array(kinds == kind))
            out["answer"] += merge(kind, own.column("keys").to_pylist(), own.column("extra").to_pylist())
            for name in ("block", "bucket", "kind"):
                out[name] += own.column(name).to_pylist()
        return pa.table({"block": pa.array(out["block"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "answer": pa.array(out["answer"], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(reply, ANSWERS)


def with_answers(blocks: DataFrame, answers: DataFrame, use: Callable[[Block, dict[int, list[bytes]]], Iterator[pa.RecordBatch] | pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
    """Bring each block together with its answers, by kind in bucket order."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        give_back()
        given: dict[int, list[bytes]] = {}
        for kind, _, answer in sorted(zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "answer")), strict=True), key=lambda x: x[:2]):
            given.setdefault(kind, []).append(answer)
        found = use(Block.of(left.to_pylist()[0]), given)
        return found if isinstance(found, pa.Table) else pa.Table.from_batches(list(found), schema=empty)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
