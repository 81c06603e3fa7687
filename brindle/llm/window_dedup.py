"""Substring dedup by words, with a count-min prefilter.

A window is `length` consecutive words.  Pass one: every block sketches its windows (`depth` rows of counters, about four
counters a window, sent as the cells it touched and whether it touched them more than once); the sketches of all blocks are
merged by adding counters, which can only overestimate, and each block learns which of its cells reached two.  Pass two:
only windows whose every cell reached two are grouped exactly, by 128 bits of window hash with the smallest document id; no
repeated window can be lost.  A word goes if a window over it also starts in a document with a smaller id.

Defined results: null and empty texts have no words; texts shorter than a window stay whole; documents with the same id
never remove from each other; a null id counts as larger than any; an empty table gives an empty result; extra columns are
ignored; texts of any length are judged whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.blocks import ASKED, Block, answered, ask, asked_rows, make_blocks, n_buckets, with_answers
from brindle.llm.shared import bucket_edges, expand, mix, pack, pack_sorted, squeeze, stage, table, unpack, unpack_sorted

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
ROWS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0), np.uint64(0x082EFA98EC4E6C89))
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def window_hashes(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start positions, documents, hash, second hash) of all windows of a block.

    Polynomials over word hashes modulo 2^64, by prefix sums: the sum up to a position, divided by the power it begins with.
    """
    n = len(block.tokens)
    counts = np.maximum(block.sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + block.starts[doc]
    out = []
    for hashes, base in zip(block.hashes(), BASES, strict=True):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.cumprod(np.full(n + 1, base), dtype=np.uint64) * inverse
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[block.tokens] * power[:n], dtype=np.uint64)])
        back = np.cumprod(np.full(n + 1, inverse), dtype=np.uint64) * base
        out.append(mix((total[at + length] - total[at]) * back[at]) if len(at) else np.zeros(0, np.uint64))
    return at, doc, out[0], out[1]


def cells_of(first: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of a sketch row as left-aligned keys, the cell of each window, and counts."""
    shift = np.uint64(64 - bits)
    cells = (mix(first ^ ROWS[row]) >> shift) << shift
    return np.unique(cells, return_inverse=True, return_counts=True)


def sketching(length: int, depth: int, bits: int):
    shift = np.uint64(64 - bits)

    def questions(block: Block):
        first = window_hashes(block, length)[2]
        for row in range(depth):
            cells, _, counts = cells_of(first, row, bits)
            yield row, cells, lambda a, b, cells=cells, counts=counts: (pack_sorted(cells[a:b] >> shift), squeeze(np.packbits(counts[a:b] > 1)))

    return lambda block: list(questions(block))


def merge_sketches(kind: int, keys: list[bytes], extras: list[bytes]) -> list[bytes]:
    """Add the counters of all partial sketches; answer which cells reached two."""
    parts = [unpack_sorted(k) for k in keys]
    counts = [1 + np.unpackbits(np.frombuffer(expand(e), np.uint8))[: len(p)].astype(np.uint64) for p, e in zip(parts, extras, strict=True)]
    cells, where = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts).astype(float), minlength=len(cells))
    full = (total >= 2)[where]
    ends = np.cumsum([len(p) for p in parts])
    return [squeeze(np.packbits(x)) for x in np.split(full, ends[:-1])]


def estimated_repeated(block: Block, given: dict[int, list[bytes]], edges_of, length: int, depth: int, bits: int):
    """Windows (position, document, hashes) whose every counter reached two."""
    at, doc, first, second = window_hashes(block, length)
    maybe = np.ones(len(at), bool)
    for row in range(depth):
        cells, where, _ = cells_of(first, row, bits)
        sizes = [n for n in np.diff(edges_of(cells)).tolist() if n]
        flags = [np.unpackbits(np.frombuffer(expand(a), np.uint8))[:n] for a, n in zip(given.get(row, []), sizes, strict=True)]
        maybe &= np.concatenate(flags).astype(bool)[where] if flags else False
    return at[maybe], doc[maybe], first[maybe], second[maybe]


def exact_keys(block: Block, windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, second hash) in order, smallest document key of each, and the key number of each window."""
    _, doc, first, second = windows
    order = np.lexsort((second, first))
    a, b, own = first[order], second[order], block.order_keys()[doc[order]]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(fresh)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return a[start], b[start], np.minimum.reduceat(own, start) if len(start) else own, number


def merge_exact(kind: int, keys: list[bytes], extras: list[bytes]) -> list[bytes]:
    """For each block's keys: does a smaller document than the block's smallest hold the window?"""
    first = [unpack_sorted(k) for k in keys]
    seconds, owners = zip(*[(unpack(e[8 : 8 + (n := int.from_bytes(e[:8], "little"))]), unpack(e[8 + n :])) for e in extras], strict=True)
    a, b, own = np.concatenate(first), np.concatenate(seconds), np.concatenate(owners)
    order = np.lexsort((b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = np.minimum.reduceat(own[order], np.flatnonzero(fresh))
    smaller = np.empty(len(a), bool)
    smaller[order] = least[np.cumsum(fresh) - 1] < own[order]
    return [squeeze(np.packbits(x)) for x in np.split(smaller, np.cumsum([len(x) for x in first])[:-1])]


def removal(block: Block, windows, smaller: np.ndarray, owners: np.ndarray, number: np.ndarray, length: int) -> np.ndarray:
    """Mask of the words that go."""
    at, doc, _, _ = windows
    goes = smaller[number] | (owners[number] < block.order_keys()[doc])
    change = np.zeros(len(block.tokens) + 1, np.int64)
    np.add.at(change, at[goes], 1)
    np.add.at(change, at[goes] + length, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 50, depth: int = 2, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and the kept words if asked for."""
    blocks = make_blocks(docs, lower=False)
    n_words = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = min(60, max(10, int(4 * n_words).bit_length()))
    buckets = n_buckets(blocks)
    def edges_of(keys: np.ndarray) -> np.ndarray:
        return bucket_edges(keys, buckets)

    sketched = stage(ask(blocks, sketching(length, depth, bits), merge_sketches), "windows-sketched", "uncompressed")

    asked_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])

    def ask_exactly(block: Block, given: dict[int, list[bytes]]):
        first, second, owners, _ = exact_keys(block, estimated_repeated(block, given, edges_of, length, depth, bits))

        def packed(a: int, b: int) -> tuple[bytes, bytes]:
            s = pack(second[a:b])
            return pack_sorted(first[a:b]), len(s).to_bytes(8, "little") + s + pack(owners[a:b])

        return asked_rows(block.block, [(depth, first, packed)], buckets)

    exact = stage(answered(with_answers(blocks, sketched, ask_exactly, ASKED, asked_schema), merge_exact), "windows-exact", "uncompressed")

    kept_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def finish(block: Block, given: dict[int, list[bytes]]) -> pa.Table:
        windows = estimated_repeated(block, given, edges_of, length, depth, bits)
        first, _, owners, number = exact_keys(block, windows)
        sizes = [n for n in np.diff(edges_of(first)).tolist() if n]
        flags = [np.unpackbits(np.frombuffer(expand(a), np.uint8))[:n] for a, n in zip(given.get(depth, []), sizes, strict=True)]
        smaller = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        goes = removal(block, windows, smaller, owners, number, length) if len(number) else np.zeros(len(block.tokens), bool)
        words = block.words
        removed = np.concatenate([[0], np.cumsum(goes)])
        rows = []
        for doc_id, start, size in zip(block.doc_ids, block.starts.tolist(), block.sizes.tolist(), strict=True):
            n_removed = int(removed[start + size] - removed[start])
            own = block.tokens[start : start + size]
            kept = b" ".join([words[w] for w in (own[~goes[start : start + size]] if n_removed else own).tolist()])
            rows.append((doc_id, size, n_removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kept_schema)], schema=kept_schema)

    return with_answers(blocks, sketched.unionByName(exact), finish, KEPT, kept_schema)


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op9_window_dedup": op9_window_dedup}
ORACLE_SQL = {
    "op9_window_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM starts),
repeated AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM repeated),
each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.at) AS body, count(*) AS n FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at GROUP BY e.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
""",
}
