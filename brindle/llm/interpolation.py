"""LM scoring by deleted interpolation.

A bigram model: the maximum-likelihood estimates of the bigram, the unigram and the uniform distribution are mixed with
weights that depend on how often the context was seen (buckets by powers of two).  The weights are learned by
expectation-maximisation on held-out counts: part of the training documents (the fold) is deleted from the counts, and the
mixture of what is left has to predict it.  Final scores use the counts of all training documents.

Counts are corpus-wide and exact: each block of documents asks for the totals of its own distinct unigrams and bigrams, so
a frequent n-gram costs one entry a block, and no model is ever sent to all tasks.  EM reads a histogram of the held-out
events over (bucket, bigram estimate, unigram estimate), with estimates in steps of 1/8 of a power of two; it covers every
held-out token, and its size is bounded whatever the corpus.

Defined results: null and empty texts are one end token; unknown words get the uniform share; without training documents
every token has the uniform probability of a vocabulary of one (score 0, base log10 1/1); without held-out events weights
stay even; repeated rows are scored and counted each; an empty table gives an empty result; extra columns are ignored; texts of any
length are scored whole, and nothing depends on the order of ties.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.blocks import Block, ask, make_blocks, with_answers
from brindle.llm.shared import mix, pack, pack_sorted, stage, table, unpack, unpack_sorted

UNIGRAM, BIGRAM = 0, 1
#: Not words, since words have no white space.
END, BEGIN = b"\n", b"\t"
TURN = np.uint64(0x9E3779B97F4A7C15)
BUCKETS, STEPS, LEVELS = 40, 8, 48 * 8
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
EVENTS = "bucket int, bigram int, unigram int, weight long"


def role(doc_id: int | None, modulus: int, remainder: int, fold_of: int) -> tuple[bool, bool]:
    """(held out for good, in the fold that EM deletes from the training counts); a null id is training text."""
    code = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    held_out = doc_id is not None and code % modulus == remainder
    return held_out, not held_out and (code // modulus) % fold_of == 0


class Grams:
    """Token positions of a block with an end token after each document, their unigram and bigram numbers, and counts."""

    def __init__(self, block: Block, roles: Callable[[int | None], tuple[bool, bool]]):
        own, _ = block.hashes()
        words = np.append(mix(own), mix(np.array([xxhash.xxh3_64_intdigest(END), xxhash.xxh3_64_intdigest(BEGIN)], np.uint64)))
        end, begin = len(own), len(own) + 1
        self.sizes = block.sizes + 1
        starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.full(int(self.sizes.sum()), end, np.int64)
        last = starts + self.sizes - 1
        inside = np.ones(len(self.tokens), bool)
        inside[last] = False
        self.tokens[inside] = block.tokens
        self.starts = starts
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[starts] = begin
        each = np.array([roles(x) for x in block.doc_ids], bool).reshape(-1, 2)
        self.held_out, self.folded = each[:, 0], each[:, 1]
        train = np.repeat(~self.held_out, self.sizes)
        self.in_fold = np.repeat(self.folded, self.sizes)
        # Contexts are unigrams as well: the start of a text is counted under a key of its own.
        seen = np.concatenate([words[self.tokens], words[[begin]].repeat(len(starts))])
        seen_train = np.concatenate([train, ~self.held_out])
        seen_fold = np.concatenate([self.in_fold, self.folded])
        self.unigrams, where = np.unique(seen, return_inverse=True)
        self.word = where[: len(self.tokens)]
        by_word = np.empty(len(words), np.int64)
        by_word[self.tokens] = self.word
        if len(starts):
            by_word[begin] = where[-1]
        self.context = by_word[before]
        self.begin_key, self.end_key = words[begin], words[end]
        pairs = mix(words[before] * TURN + words[self.tokens])
        self.bigrams, self.pair = np.unique(pairs, return_inverse=True)

        def count(number: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
            return np.bincount(number[mask], minlength=n).astype(np.uint64)

        self.unigram_counts = count(where, seen_train, len(self.unigrams)), count(where, seen_fold, len(self.unigrams))
        self.bigram_counts = count(self.pair, train, len(self.bigrams)), count(self.pair, self.in_fold, len(self.bigrams))


def two(a: np.ndarray, b: np.ndarray) -> bytes:
    first = pack(a)
    return len(first).to_bytes(8, "little") + first + pack(b)


def apart(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return unpack(data[8 : 8 + n]), unpack(data[8 + n :])


def questions_of(roles):
    def questions(block: Block):
        grams = Grams(block, roles)
        out = []
        for kind, keys, (train, fold) in ((UNIGRAM, grams.unigrams, grams.unigram_counts), (BIGRAM, grams.bigrams, grams.bigram_counts)):
            out.append((kind, keys, lambda a, b, keys=keys, train=train, fold=fold: (pack_sorted(keys[a:b]), two(train[a:b], fold[a:b]))))
        return out

    return questions


def merge_counts(kind: int, keys: list[bytes], extras: list[bytes]) -> list[bytes]:
    """Total counts for everyone's keys.  Unigram answers begin with the bucket's share of N, N of the fold, and V."""
    parts = [unpack_sorted(k) for k in keys]
    train, fold = (np.concatenate(x) for x in zip(*map(apart, extras), strict=True))
    distinct, where = np.unique(np.concatenate(parts), return_inverse=True)
    totals = [np.bincount(where, weights=c.astype(float), minlength=len(distinct)).astype(np.uint64) for c in (train, fold)]
    head = b""
    if kind == UNIGRAM:
        real = distinct != mix(np.array([xxhash.xxh3_64_intdigest(BEGIN)], np.uint64))[0]
        head = b"".join(int(x).to_bytes(8, "little") for x in (totals[0][real].sum(), totals[1][real].sum(), ((totals[0] > 0) & real).sum()))
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return [head + two(a, b) for a, b in zip(np.split(totals[0][where], ends), np.split(totals[1][where], ends), strict=True)]


def counted(given: dict[int, list[bytes]], kind: int) -> tuple[np.ndarray, np.ndarray]:
    skip = 24 if kind == UNIGRAM else 0
    pairs = [apart(a[skip:]) for a in given.get(kind, [])]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


def totals_of(answers: DataFrame) -> tuple[int, int, int]:
    """N, N of the fold, V: the shares of all buckets, each once."""

    def heads(batches):
        for batch in batches:
            rows = [[int.from_bytes(a[i : i + 8], "little") for i in (0, 8, 16)] for a in batch.column("answer").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]], names=["bucket", "n", "fold", "v"])

    each = answers.where(F.col("kind") == UNIGRAM).groupBy("bucket").agg(F.min(F.substring("answer", 1, 24)).alias("answer"))
    row = each.mapInArrow(heads, "bucket int, n long, fold long, v long").agg(F.sum("n"), F.sum("fold"), F.sum("v")).first()
    return tuple(int(x or 0) for x in row)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then by powers of two."""
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def level(p: np.ndarray) -> np.ndarray:
    """Estimates in steps of 1/8 of a power of two; LEVELS stands for 0."""
    return np.where(p > 0, np.minimum(np.round(-np.log2(np.where(p > 0, p, 1.0)) * STEPS), LEVELS - 1), LEVELS).astype(np.int64)


def held_out_events(blocks: DataFrame, answers: DataFrame, roles, n: int, n_fold: int) -> DataFrame:
    """The fold's tokens by (context bucket, bigram estimate, unigram estimate) under the counts without the fold."""
    schema = pa.schema([("bucket", pa.int32()), ("bigram", pa.int32()), ("unigram", pa.int32()), ("weight", pa.int64())])

    def events(block: Block, given: dict[int, list[bytes]]) -> pa.Table:
        grams = Grams(block, roles)
        (uni, uni_fold), (bi, bi_fold) = counted(given, UNIGRAM), counted(given, BIGRAM)
        at = np.flatnonzero(grams.in_fold)
        context = (uni - uni_fold)[grams.context[at]]
        p2 = ratio((bi - bi_fold)[grams.pair[at]], context)
        p1 = (uni - uni_fold)[grams.word[at]] / max(1, n - n_fold)
        code = (context_bucket(context) * (LEVELS + 1) + level(p2)) * (LEVELS + 1) + level(p1)
        code, weight = np.unique(code, return_counts=True)
        rest, unigram = np.divmod(code, LEVELS + 1)
        bucket, bigram = np.divmod(rest, LEVELS + 1)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((bucket, bigram, unigram, weight), schema, strict=True)], schema=schema)

    found = with_answers(blocks, answers, events, EVENTS, schema)
    return found.groupBy("bucket", "bigram", "unigram").agg(F.sum("weight").alias("weight"))


def learn(events: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """EM for the weights of (bigram, unigram, uniform) in each bucket; buckets without events take those of all."""
    value = np.where(np.arange(LEVELS + 1) < LEVELS, 2.0 ** (-np.arange(LEVELS + 1) / STEPS), 0.0)

    def fit(rows: np.ndarray) -> np.ndarray:
        mix3 = np.full(3, 1 / 3)
        parts = np.stack([value[rows[:, 1]], value[rows[:, 2]], np.full(len(rows), 1 / (vocabulary + 1))], axis=1)
        for _ in range(rounds if len(rows) else 0):
            share = parts * mix3
            share *= (rows[:, 3] / share.sum(axis=1))[:, None]
            mix3 = share.sum(axis=0) / share.sum()
        return mix3

    overall = fit(events)
    out = np.stack([fit(own) if len(own := events[events[:, 0] == b]) else overall for b in range(BUCKETS)])
    out[0] = [0.0, out[0, 1] + out[0, 0], out[0, 2]]
    # Some mass always stays on the lower orders, so that nothing has probability zero.
    out = np.maximum(out, [[0.0, 1e-6, 1e-6]])
    return out / out.sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, fold_of: int = 8) -> DataFrame:
    """Score every document; rows whose crc32(doc_id as text) mod `modulus` is `remainder` are not learned from."""

    def roles(doc_id: int | None) -> tuple[bool, bool]:
        return role(doc_id, modulus, remainder, fold_of)

    blocks = make_blocks(docs, lower=True)
    answers = stage(ask(blocks, questions_of(roles), merge_counts), "ngram-counts", "uncompressed")
    n, n_fold, v = totals_of(answers)
    events = np.array([tuple(r) for r in held_out_events(blocks, answers, roles, n, n_fold).collect()], np.int64).reshape(-1, 4)
    weights = learn(events[np.lexsort(events.T[::-1])], v) if n else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(block: Block, given: dict[int, list[bytes]]) -> pa.Table:
        grams = Grams(block, roles)
        uni, bi = counted(given, UNIGRAM)[0], counted(given, BIGRAM)[0]
        count, context = uni[grams.word], uni[grams.context]
        use = weights[context_bucket(context)]
        p = use[:, 0] * ratio(bi[grams.pair], context) + use[:, 1] * (count / max(1, n)) + use[:, 2] / (v + 1)

        def add(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, grams.starts) if len(grams.starts) else x[:0]

        columns = (block.doc_ids, grams.held_out, grams.sizes, add((count > 0).astype(np.int64)), np.full(len(grams.sizes), n), add(np.log10((count + 1) / (n + 1 * (v + 1)))), add(np.log10(p)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return with_answers(blocks, answers, score, SCORES, schema)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_deleted_interpolation": op1_deleted_interpolation}
ORACLE_SQL: dict[str, str] = {}
