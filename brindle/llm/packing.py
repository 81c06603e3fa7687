"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of documents; a window (a training sequence) takes from every queue the tokens that its target
proportion gives it, and what rounding leaves over or short is a deficit that the next window settles.  The rounds are not
run one after another: for target proportions fixed in advance, the state of the scheduler after any number of windows has
a closed form (`Schedule.cuts`).  So any task places any document from three numbers (its queue, its offset there, its
length), and deficits carry across windows and across partitions without any partition waiting for another.

Queues are emptied completely.  At temperature 1 the targets are the sources' shares of all tokens, so that all queues run
dry together and every window has the mixture of the corpus; otherwise a queue that runs dry gives its share to the others in
proportion.  The query's targets are tempered by 0.7, which gives small sources more of the early windows.  Windows are filled to the last token, so only the last one is padded.

Defined results: null text counts as empty and gives the one end token; a null source is a queue of its own; repeated rows
are packed each; an empty table gives an empty result; extra columns are ignored; texts are never truncated.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.shared import stage, table

END = 0
#: Chunk offsets up to this many rows are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
STAGED = "doc_id long, queue string, chunk long, before long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids binary"
#: Runs without a word boundary are merged in quadratic time by the fast encoder; such texts go to the other one.
LONG_RUN = re.compile(r"\S{400}|\s{400}")


def has_long_run(text: str) -> bool:
    """Is there a run of 400?  It would cover one of the text's pieces of 200 whole, so mostly these decide."""
    if not any(len(text[at : at + 200].split(None, 1)) < 2 for at in range(0, len(text) - 199, 200)):
        return False
    return LONG_RUN.search(text) is not None


class Encoder:
    """Token ids of the byte-level vocabulary `name`, as `Tokenizer.encode` gives them.

    Both libraries read the same vocabulary; only `slow` knows the added tokens, so it gets the texts that hold one.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.added = [token.content for token in self.slow.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if has_long_run(text) or any(token in text for token in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Schedule:
    """The closed form of weighted deficit round-robin over queues of known length.

    In the fluid limit every queue is served at its share of the weights that are still active; `times` are the moments (in
    tokens served) at which a queue runs dry, `served` what each queue had got by then.  Token j of a queue is due when the
    fluid service reaches j + 1/2; windows take tokens by due time, ties by queue.  At a window's end a queue is ahead of or
    behind its share by a token or so (at most half a token for each queue); that difference is the deficit carried over.
    """

    def __init__(self, totals: list[int], weights: list[float] | None, length: int):
        self.totals, self.length = np.array(totals, np.int64), length
        self.total = int(self.totals.sum())
        weight = np.array(self.totals if weights is None else weights, float)
        if (weight < 0).any() or len(weight) != len(self.totals):
            raise ValueError("one weight of at least 0 for each queue")
        left, now = self.totals.astype(float), 0.0
        times, served = [0.0], [np.zeros(len(left))]
        while (left > 0).any():
            active = np.where(left > 0, weight, 0.0)
            if not active.any():
                active = np.where(left > 0, left, 0.0)
            share = active / active.sum()
            lasts = np.min(left[share > 0] / share[share > 0])
            left = np.where(share > 0, left - share * lasts, left)
            left[(share > 0) & (left < 0.25)] = 0.0
            now += lasts
            times.append(now)
            served.append(self.totals - left)
        times[-1] = float(self.total)
        self.times, self.served = np.array(times), np.stack(served)

    def due(self, queue: int, token: np.ndarray) -> np.ndarray:
        return np.interp(token + 0.5, self.served[:, queue], self.times)

    def cuts(self, windows: np.ndarray) -> np.ndarray:
        """Tokens taken from each queue in all windows before each of `windows`; rows sum to window * length exactly."""
        goal = np.minimum(windows.astype(np.int64) * self.length, self.total)
        queues = range(len(self.totals))
        taken = np.stack([np.floor(np.interp(goal, self.times, self.served[:, q]) + 0.5) for q in queues], axis=1).astype(np.int64)
        taken = np.minimum(taken, self.totals)
        off = goal - taken.sum(axis=1)
        while len(rows := np.flatnonzero(off > 0)):
            key = np.stack([np.where(taken[rows, q] < self.totals[q], self.due(q, taken[rows, q]), np.inf) for q in queues], axis=1)
            taken[rows, key.argmin(axis=1)] += 1
            off[rows] -= 1
        while len(rows := np.flatnonzero(off < 0)):
            key = np.stack([np.where(taken[rows, q] > 0, self.due(q, taken[rows, q] - 1), -np.inf) for q in queues], axis=1)
            taken[rows, key.shape[1] - 1 - key[:, ::-1].argmax(axis=1)] -= 1
            off[rows] += 1
        return taken


class ManyQueues(Schedule):
    """The same order of tokens for more queues than a window has tokens, in bounded memory.

    A cut at `goal` is the first `goal` tokens by due time, ties by queue.  Bisection finds a moment by which at most `goal` tokens are due
    and after which no queue has more than one of the rest; these are taken in order.  Work is done in blocks of windows.
    """

    CELLS = 2_000_000

    def rows_at_once(self) -> int:
        return max(1, self.CELLS // len(self.totals))

    def taken_by(self, moments: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are due by each of `moments`."""
        at = np.clip(np.searchsorted(self.times, moments, side="right") - 1, 0, len(self.times) - 2)
        width = np.maximum(self.times[at + 1] - self.times[at], 1e-9)
        part = np.clip((moments - self.times[at]) / width, 0.0, 1.0)[:, None]
        got = self.served[at] + part * (self.served[at + 1] - self.served[at])
        return np.minimum(np.floor(got + 0.5).astype(np.int64), self.totals)

    def cuts(self, windows: np.ndarray) -> np.ndarray:
        goals = np.minimum(windows.astype(np.int64) * self.length, self.total)
        blocks = [self._cuts(goals[at : at + self.rows_at_once()]) for at in range(0, len(goals), self.rows_at_once())]
        return np.concatenate(blocks) if blocks else np.zeros((0, len(self.totals)), np.int64)

    def _cuts(self, goals: np.ndarray) -> np.ndarray:
        n = len(self.totals)
        low, high = np.maximum(goals - n / 2 - 1, 0.0), np.minimum(goals + n / 2 + 1, float(self.total))
        for _ in range(int(np.log2(n + 2)) + 8):
            middle = (low + high) / 2
            under = self.taken_by(middle).sum(axis=1) <= goals
            low, high = np.where(under, middle, low), np.where(under, high, middle)
        taken = self.taken_by(low)
        key = np.stack([np.where(taken[:, q] < self.totals[q], self.due(q, taken[:, q]), np.inf) for q in range(n)], axis=1)
        for row, off in enumerate(goals - taken.sum(axis=1)):
            if off:
                taken[row, np.argsort(key[row], kind="stable")[:off]] += 1
        return taken

    def between(self, queue: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the windows that hold the tokens first to last of a queue: all that are surely due before, and maybe by then."""
        low, high = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for at in range(0, len(first), self.rows_at_once()):
            own = slice(at, at + self.rows_at_once())
            low[own] = self.taken_by(self.due(queue, first[own]) - 1e-3).sum(axis=1) // self.length
            high[own] = self.taken_by(self.due(queue, last[own]) + 1e-3).sum(axis=1) // self.length
        return low, high


def encoder_of(name: str, rows_at_once: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Token ids per document; `before` counts the tokens of the same queue earlier in the same task (its chunk)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk, before = None, TaskContext.get().partitionId(), {}
        for whole in batches:
            encoder = encoder or Encoder(name)
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                ids, starts, counts = [], [], []
                queues = batch.column("queue").to_pylist()
                for queue, text in zip(queues, batch.column("text").to_pylist(), strict=True):
                    found = np.array([*encoder.ids(text or ""), END], np.dtype("<u4"))
                    ids.append(found.astype("<u2").tobytes())
                    starts.append(before.get(queue, 0))
                    counts.append(len(found))
                    before[queue] = starts[-1] + len(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("queue"), pa.array([chunk] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "chunk", "before", "doc_tokens", "ids"],
                )

    return encode


def cutter(names: list[str], schedule: Schedule, with_ids: bool, rows_at_once: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts documents at the window boundaries of their queue and places the pieces."""
    number = {name: k for k, name in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                queue = np.array([number[x] for x in batch.column("queue").to_pylist()])
                first = batch.column("place").to_numpy(zero_copy_only=False)
                tokens = batch.column("doc_tokens").to_numpy(zero_copy_only=False)
                low, high = np.zeros(len(queue), np.int64), np.zeros(len(queue), np.int64)
                many = isinstance(schedule, ManyQueues)
                slack = 2 + len(names) // schedule.length
                for q in np.unique(queue):
                    own = queue == q
                    if many:
                        low[own], high[own] = schedule.between(q, first[own], first[own] + tokens[own] - 1)
                        continue
                    low[own] = schedule.due(q, first[own]) // schedule.length - slack
                    high[own] = schedule.due(q, first[own] + tokens[own] - 1) // schedule.length + slack
                low = np.maximum(low, 0)
                spans = high - low + 1
                doc = np.repeat(np.arange(len(queue)), spans)
                window = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans) + low[doc]
                of = queue[doc]
                begin, end, before = (np.zeros(len(doc), np.int64) for _ in range(3))
                asked = np.unique(window)
                step = schedule.rows_at_once() if many else max(1, len(asked))
                for k in range(0, len(asked), step):
                    block = asked[k : k + step]
                    known = np.unique(np.concatenate([block, block + 1]))
                    taken = schedule.cuts(known)
                    share = np.diff(taken, axis=0)
                    lead = np.cumsum(share, axis=1) - share
                    own = np.flatnonzero((window >= block[0]) & (window <= block[-1]))
                    here = np.searchsorted(known, window[own])
                    begin[own], end[own], before[own] = taken[here, of[own]], taken[here + 1, of[own]], lead[here, of[own]]
                start, stop = np.maximum(begin, first[doc]), np.minimum(end, first[doc] + tokens[doc])
                keep = stop > start
                doc, window, begin, start, stop, ahead = (x[keep] for x in (doc, window, begin, start, stop, before))
                inner = start - first[doc]
                size = stop - start
                raw = batch.column("ids")
                crcs, pieces, last, wide = [], [], -1, b""
                for d, i, n in zip(doc.tolist(), (inner * 4).tolist(), (size * 4).tolist(), strict=True):
                    if d != last:
                        wide, last = memoryview(np.frombuffer(raw[d].as_buffer(), "<u2").astype("<u4").tobytes()), d
                    piece = wide[i : i + n]
                    crcs.append(zlib.crc32(piece))
                    pieces.append(bytes(piece) if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(inner), pa.array(size), pa.array(crcs, pa.int64()), batch.column("doc_tokens").take(pa.array(doc)), pa.array(window), pa.array(ahead + start - begin), batch.column("queue").take(pa.array(doc)), pa.array(pieces, pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"],
                )

    return cut


def pack_documents(docs: DataFrame, queue: str = "source", length: int = 1024, weights: dict[str | None, float] | None = None, temperature: float = 1.0, tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of `length` tokens; `ids` holds little-endian 32-bit ids if asked for.

    Target proportions are `weights` by source, or else the sources' tokens to the power `temperature`.
    More than `length` queues are placed by `ManyQueues`: the same order, in time that grows with windows times queues.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(queue).cast("string")), F.lit(""))  # a null source stays apart from any name
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("queue"), F.col("text").alias("text"))
    staged = stage(rows.mapInArrow(encoder_of(tokenizer), STAGED), "packing-ids")
    chunks = staged.groupBy("queue", "chunk").agg(F.sum("doc_tokens").alias("tokens"))
    ahead = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    places = stage(chunks.select("queue", "chunk", "tokens", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base")), "packing-places")
    totals = {r["queue"]: r["tokens"] for r in places.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(totals)
    if weights is not None:
        share = [float(weights.get(x[1:] or None, 0.0)) for x in names]
    else:
        share = None if temperature == 1 else [float(totals[x]) ** temperature for x in names]
    schedule = (Schedule if len(names) <= length else ManyQueues)([totals[x] for x in names], share, length)
    base = places.select("queue", "chunk", "base")
    if places.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = staged.join(base, ["queue", "chunk"]).select("doc_id", "queue", "doc_tokens", (F.col("base") + F.col("before")).alias("place"), "ids")
    out = placed.mapInArrow(cutter(names, schedule, with_ids), PIECES)
    return out.withColumn("queue", F.when(F.col("queue") != "", F.substring("queue", 2, 1 << 30)))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), temperature=0.7).withColumnRenamed("queue", "source").drop("ids")


QUERIES = {"op4_mixture_packing": op4_mixture_packing}
ORACLE_SQL: dict[str, str] = {}
