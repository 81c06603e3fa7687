"""Suffix-array dedup: byte strings of a given length that start more than once are found by a sparse suffix array that is
sorted deep-shallow, and every byte they cover is removed.

1. Anchors.  Every window of `length` bytes has an anchor: the least hash among its k-grams (k = length / 2, leftmost on
   ties).  Anchors depend on the window's bytes alone, so equal windows have equal anchors at the same offset; about one
   position in fifty is an anchor.  Blocks of documents ask which of their anchors occur anywhere else.
2. Contexts.  Around a repeated anchor, the `length - k` bytes before it and the `length` bytes from it on decide everything.
   Equal contexts are collapsed; one copy of each goes to the anchor's bucket.  An anchor with very many contexts (the edge
   of a passage that a large part of the corpus quotes) is split: windows are divided by how far before the anchor they
   start, eight offsets at a time, and go to the bucket of the bytes that all windows of that division share.
3. Deep-shallow sorting.  A bucket sorts its suffixes (each anchor's text onwards) by multikey quicksort to a shallow depth,
   eight bytes at a time and all groups at once; groups that are still tied go to blind tries, which order them with one
   comparison of texts an insertion and give the longest common prefixes.  The reversed texts before the anchors are sorted
   in the same way.
4. A window at offset o before its anchor repeats if another context shares o bytes before and length - o bytes from the
   anchor on: both are runs of the two suffix orders with long enough common prefixes.

Anchors and equal contexts are compared by 64-bit hashes each; texts decide the rest.  Defined results: null and empty
texts have no bytes; texts shorter than `length` stay whole; repeated rows count as separate texts, so all lose what they
share; an empty table gives an empty result; extra columns are ignored; texts are judged whole and matches end with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.blocks import ASKED, answered, asked_rows, n_buckets
from brindle.llm.shared import bucket_edges, expand, give_back, mix, octets, pack, pack_sorted, squeeze, stage, table, unpack, unpack_sorted

TEXTS = "block long, doc_ids array<long>, sizes array<long>, text binary"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: An anchor with more distinct contexts than this, or more than PER_BLOCK in one block, is split by offset.
HOT_CONTEXTS, PER_BLOCK, DIVISION = 512, 64, 8
UNIQUE, SHARED, FIRST, HOT = 0, 1, 2, 3
SHALLOW = 32


def random_bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))


BYTE = [random_bytes_table(b) for b in BASES]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    one, inverse = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    one[0] = inverse[0] = 1
    return np.cumprod(one, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, current = 1, values
    while size * 2 <= width:
        current = np.minimum(current[:-size], current[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(current[:n], current[width - size : width - size + n])


class Anchors:
    """Anchors of a block: position, document, range of window offsets [low, high], hash, context hash; in text order."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, length: int):
        self.text, self.sizes, self.length = text, sizes, length
        self.k = length // 2
        self.left = length - self.k
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        doc_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        wide = CHUNK + 3 * length
        self.powers = [powers(b, wide + 1) for b in BASES]
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        for s in range(0, max(0, len(text) - length + 1), CHUNK):
            for store, part in zip(found, self.chunk(s, min(s + CHUNK, len(text) - length + 1), doc_of), strict=True):
                store.append(part)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.at, self.doc, first, last, self.key, self.context = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, kinds, strict=True))
        if len(self.at):  # an anchor whose windows lie in two chunks
            fresh = np.ones(len(self.at), bool)
            fresh[1:] = (self.at[1:] != self.at[:-1]) | (self.doc[1:] != self.doc[:-1])
            start = np.flatnonzero(fresh)
            last = np.maximum.reduceat(last, start)
            self.at, self.doc, first, self.key, self.context = (x[start] for x in (self.at, self.doc, first, self.key, self.context))
        self.low, self.high = self.at - last, self.at - first

    def sums(self, which: int, part: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[which][part] * self.powers[which][0][: len(part)], dtype=np.uint64)])

    def chunk(self, s: int, e: int, doc_of: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors of the windows that start in [s, e)."""
        base, top = max(0, s - self.left), min(len(self.text), e + 2 * self.length)
        part = self.text[base:top]
        total = self.sums(0, part)
        at = np.arange(s - base, e - base + self.left)
        grams = mix((total[at + self.k] - total[at]) * self.powers[0][1][at])
        low_bits = np.uint64((1 << 20) - 1)
        least = sliding_min((grams & ~low_bits) | np.arange(len(at), dtype=np.uint64), self.left + 1)
        window = np.arange(s, e)
        doc = doc_of[s:e].astype(np.int64)
        valid = window + self.length <= self.ends[doc]
        window, doc, anchor = window[valid], doc[valid], (least[valid] & low_bits).astype(np.int64) + s
        if not len(window):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
        fresh = np.ones(len(window), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], len(window)) - 1
        anchor, doc = anchor[start], doc[start]
        context = self.hash_between(np.maximum(anchor - self.left, self.begins[doc]), anchor, np.minimum(anchor + self.length, self.ends[doc]), self.sums(1, part), base)
        # Least hashes crowd near zero: hashed again, so that key ranges are even.
        return anchor, doc, window[start], window[stop], mix(grams[anchor - s] ^ np.uint64(BASES[1])), context

    def hash_between(self, begin: np.ndarray, at: np.ndarray, end: np.ndarray, total: np.ndarray, base: int) -> np.ndarray:
        """Hash of text[begin:end] and of where `at` lies in it."""
        value = (total[end - base] - total[begin - base]) * self.powers[1][1][begin - base]
        return mix(value + (at - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (end - at).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context of some anchors: from, to."""
        at, doc = self.at[rows], self.doc[rows]
        return np.maximum(at - self.left, self.begins[doc]), np.minimum(at + self.length, self.ends[doc])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order-first index of each distinct pair, number of each row's pair, count of each pair), sorted by a, then b."""
    order = np.lexsort((b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    start = np.flatnonzero(fresh)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[start], number, np.diff(np.append(start, len(a)))


# Blocks


def blocker(block_bytes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = (pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([squeeze(b"".join(texts))], pa.binary()))
            return pa.RecordBatch.from_arrays(list(columns), names=["block", "doc_ids", "sizes", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), octets(batch.column("text")), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 64
                if held >= block_bytes:
                    yield flush()
                    number, ids, texts, held = number + 1, [], [], 0
                    give_back()
        if ids:
            yield flush()
        ids, texts = [], []
        give_back()

    return build


def anchors_of(row: dict, length: int) -> Anchors:
    return Anchors(np.frombuffer(expand(row["text"]), np.uint8), np.array(row["sizes"], np.int64), length)


class Entries:
    """What a block asks in round one: its distinct (anchor, context) pairs, at most PER_BLOCK contexts an anchor."""

    def __init__(self, anchors: Anchors):
        first, number, count = distinct_pairs(anchors.key, anchors.context)
        key = anchors.key[first]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(fresh)
        place = np.arange(len(key)) - start[np.cumsum(fresh) - 1] if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.append(start, len(key))) > PER_BLOCK
        over = many[np.cumsum(fresh) - 1] if len(key) else np.zeros(0, bool)
        self.number, self.sent = number, np.flatnonzero(place < PER_BLOCK)
        self.key, self.context = key[self.sent], anchors.context[first][self.sent]
        self.flags = (count[self.sent] > 1).astype(np.uint8) | (over[self.sent].astype(np.uint8) << 1)
        self.first, self.over = first, over

    def codes(self, answers: list[bytes]) -> np.ndarray:
        """The code of each distinct pair, sent or not (not sent: hot)."""
        out = np.full(len(self.first), HOT, np.uint8)
        out[self.sent] = np.frombuffer(b"".join(map(expand, answers)), np.uint8)
        return out


def merge_anchors(keys: list[bytes], extras: list[bytes]) -> list[bytes]:
    """A code for each sent pair: unique, shared, shared and chosen to send its text, or hot."""
    parts = [unpack_sorted(k) for k in keys]
    n = [int.from_bytes(e[:8], "little") for e in extras]
    context = np.concatenate([unpack(e[8 : 8 + m]) for e, m in zip(extras, n, strict=True)])
    flags = np.frombuffer(b"".join(expand(e[8 + m :]) for e, m in zip(extras, n, strict=True)), np.uint8)
    key = np.concatenate(parts)
    first, number, count = distinct_pairs(key, context)
    distinct, group = np.unique(key, return_inverse=True)
    copies = np.bincount(group, weights=1 + (flags & 1), minlength=len(distinct))
    contexts = np.bincount(group[first], minlength=len(distinct))
    over = np.bincount(group, weights=flags >> 1, minlength=len(distinct)) > 0
    code = np.where(copies[group] > 1, SHARED, UNIQUE).astype(np.uint8)
    chosen = np.zeros(len(key), bool)
    chosen[first] = True
    code[chosen & (code == SHARED)] = FIRST
    code[(over | (contexts > HOT_CONTEXTS))[group]] = HOT
    return [squeeze(x) for x in np.split(code, np.cumsum([len(p) for p in parts])[:-1])]


class Cases:
    """What a block asks in round two: cases (key, context) with a range of offsets, and the texts it was chosen to send."""

    def __init__(self, anchors: Anchors, entries: Entries, answers: list[bytes]):
        code = entries.codes(answers) if len(entries.first) else np.zeros(0, np.uint8)
        each = code[entries.number] if len(code) else np.zeros(0, np.uint8)
        plain = np.flatnonzero((each == SHARED) | (each == FIRST))
        begin, end = anchors.bounds(plain)
        rows, key, context, low, high, begins, ends, send = [plain], [anchors.key[plain]], [anchors.context[plain]], [anchors.low[plain]], [anchors.high[plain]], [begin], [end], [each[plain] == FIRST]
        hot = np.flatnonzero(each == HOT)
        for o in range(0, anchors.left + 1, DIVISION) if len(hot) else ():
            # Windows that start o .. o + DIVISION - 1 bytes before the anchor share `near` and lie in `far`.
            last = min(o + DIVISION - 1, anchors.left)
            own = hot[(anchors.low[hot] <= last) & (anchors.high[hot] >= o)]
            begin, end = anchors.bounds(own)
            at = anchors.at[own]
            far = np.maximum(begin, at - last), np.minimum(end, at + anchors.length - o)
            near = np.maximum(begin, at - o), np.minimum(end, at + anchors.length - last)
            rows.append(own)
            key.append(mix(anchors.key[own] + hashes_of(anchors.text, *near) * np.uint64(2 * o + 3)))
            context.append(mix(hashes_of(anchors.text, *far) + (at - far[0]).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            low.append(np.maximum(anchors.low[own], o))
            high.append(np.minimum(anchors.high[own], last))
            begins.append(far[0])
            ends.append(far[1])
            send.append(np.ones(len(own), bool))
        self.rows = np.concatenate(rows)
        every_key, every_context = np.concatenate(key), np.concatenate(context)
        first, self.number, count = distinct_pairs(every_key, every_context)
        self.key, self.context = every_key[first], every_context[first]
        self.several = count > 1
        self.send = np.concatenate(send)[first]
        self.low, self.high = np.concatenate(low)[first], np.concatenate(high)[first]
        self.begin, self.end, self.at = np.concatenate(begins)[first], np.concatenate(ends)[first], anchors.at[self.rows[first]]
        self.text = anchors.text

    def packed(self, a: int, b: int) -> tuple[bytes, bytes]:
        sent = np.flatnonzero(self.send[a:b]) + a
        texts = b"".join(self.text[x:y].tobytes() for x, y in zip(self.begin[sent].tolist(), self.end[sent].tolist(), strict=True))
        shapes = np.stack([self.at[sent] - self.begin[sent], self.end[sent] - self.at[sent], self.low[sent], self.high[sent]]).astype("<u4")
        flags = self.several[a:b].astype(np.uint8) | (self.send[a:b].astype(np.uint8) << 1)
        parts = (pack(self.context[a:b]), squeeze(flags), squeeze(shapes), squeeze(texts))
        return pack_sorted(self.key[a:b]), np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)


def hashes_of(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = memoryview(text)
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)


# Deep-shallow sorting


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """A Patricia trie that knows only branching depths and branching bytes; leaves hold the numbers of equal texts."""

    class Fork:
        __slots__ = ("depth", "children")

        def __init__(self, depth: int, children: dict):
            self.depth, self.children = depth, children

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None
        for i in range(len(texts)):
            self.insert(i)

    def insert(self, i: int) -> None:
        text = self.texts[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while type(node) is not list:  # blindly down to any leaf that could be nearest
            path.append(node)
            child = node.children.get(text[node.depth] if node.depth < len(text) else -1)
            node = child if child is not None else next(iter(node.children.values()))
        other = self.texts[node[0]]
        depth = common_prefix(text, other)
        if depth == len(text) == len(other):
            node.append(i)
            return
        step = 0
        while step < len(path) and path[step].depth < depth:
            step += 1
        own = text[depth] if depth < len(text) else -1
        if step < len(path) and path[step].depth == depth:
            path[step].children[own] = [i]
            return
        below = path[step] if step < len(path) else node
        fork = self.Fork(depth, {other[depth] if depth < len(other) else -1: below, own: [i]})
        if step:
            above = path[step - 1]
            above.children[text[above.depth] if above.depth < len(text) else -1] = fork
        else:
            self.root = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in text order, and each one's common prefix with the one before it (the first: -1)."""
        order, common, stack = [], [], [(self.root, -1)]
        while stack:
            node, shared = stack.pop()
            if type(node) is list:
                order += node
                common += [shared] + [len(self.texts[node[0]])] * (len(node) - 1)
            else:
                keys = sorted(node.children)
                stack += [(node.children[c], node.depth if c != keys[0] else shared) for c in reversed(keys)]
        return order, common


def multikey_groups(rows: np.ndarray, order: np.ndarray, shallow: int) -> np.ndarray:
    """Sort `order` by the first `shallow` bytes of the rows, in place; returns where each group of rows equal so far begins.

    Ternary multikey quicksort, all open groups at once: a group is split by the eight bytes at its depth into those below,
    equal to and above its pivot; only the equal part goes on eight bytes deeper.
    """
    n, width = rows.shape
    deep = -(-min(shallow, width) // 8) * 8
    padded = np.zeros((n, deep), np.uint8)
    padded[:, : min(deep, width)] = rows[:, : min(deep, width)]
    if deep > shallow:
        padded[:, shallow:] = 0
    words = padded.view(">u8").astype(np.uint64)
    begins, depth = np.zeros(n, bool), np.zeros(n, np.int64)
    begins[:1] = True
    while True:
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, n))
        group = np.repeat(np.arange(len(start)), size)
        at = np.flatnonzero(((size > 1) & (depth[start] < words.shape[1]))[group]) if n else start
        if not len(at):
            return start
        own = group[at]
        key, pivot = words[order[at], depth[at]], words[order[(start + size // 2)[own]], depth[at]]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        inner = np.argsort(own * 3 + side, kind="stable")
        order[at], side = order[at][inner], side[inner]
        depth[at] += side == 1
        begins[at[1:]] |= (own[1:] == own[:-1]) & (side[1:] != side[:-1])


def deep_shallow(rows: np.ndarray, sizes: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of texts (zero-padded rows of a matrix, with sizes) and common prefix of each with the one before in the order."""
    n = len(rows)
    order = np.arange(n)
    start = multikey_groups(rows, order, shallow)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    common = np.zeros(n, np.int64)
    if n > 1:  # between groups: the first difference lies within the shallow depth
        edge = np.flatnonzero(group[1:] != group[:-1]) + 1
        differ = rows[order[edge], :shallow] != rows[order[edge - 1], :shallow]
        common[edge] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), shallow), np.minimum(sizes[order[edge]], sizes[order[edge - 1]]))
    for a, b in zip(start.tolist(), np.append(start[1:], n).tolist(), strict=True):
        if b - a > 1:
            members = order[a:b]
            trie = BlindTrie([rows[i, : sizes[i]].tobytes() for i in members.tolist()])
            inner, shared = trie.ordered()
            order[a:b] = members[inner]
            common[a + 1 : b] = shared[1:]
    return order, common


def runs_of(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Number of each text's run of texts that share `depth` bytes."""
    cut = common < depth
    cut[:1] = True
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(cut)
    return out


def merge_cases(length: int):
    left_width = length - length // 2

    def merge(keys: list[bytes], extras: list[bytes]) -> list[bytes]:
        """For every case: the largest repeated offset plus one (0: none) and the smallest."""
        parts = [unpack_sorted(k) for k in keys]
        contexts, flags, shapes, texts = [], [], [], []
        for extra in extras:
            ends = 32 + np.cumsum(np.frombuffer(extra[:32], "<u8").astype(np.int64))
            contexts.append(unpack(extra[32 : ends[0]]))
            flags.append(np.frombuffer(expand(extra[ends[0] : ends[1]]), np.uint8))
            shapes.append(np.frombuffer(expand(extra[ends[1] : ends[2]]), "<u4").reshape(4, -1).astype(np.int64))
            texts.append(expand(extra[ends[2] : ends[3]]))
        key, context, flag = np.concatenate(parts), np.concatenate(contexts), np.concatenate(flags)
        first, number, _ = distinct_pairs(key, context)
        copies = np.bincount(number, weights=1 + (flag & 1), minlength=len(first))
        before, after, low, high = np.concatenate(shapes, axis=1)
        sender = np.flatnonzero(flag >> 1)
        chosen, pick = np.unique(number[sender], return_index=True)  # one text for each distinct case
        raw = np.frombuffer(b"".join(texts), np.uint8)
        size = before + after
        begin = (np.cumsum(size) - size)[pick]
        before, after, low, high = (x[pick] for x in (before, after, low, high))
        _, group = np.unique(key[first][chosen], return_inverse=True)
        alone = (np.bincount(group)[group] == 1) & (copies[chosen] < 2)
        top, bottom = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        live = np.flatnonzero(~alone)
        if len(live):
            begin, before, after, low, high, group, weight = (x[live] for x in (begin, before, after, low, high, group, copies[chosen]))
            middle = begin + before
            right = np.zeros((len(live), length), np.uint8)
            back = np.zeros((len(live), left_width), np.uint8)
            for matrix, sizes, sign in ((right, after, 1), (back, before, -1)):
                columns = np.arange(matrix.shape[1])
                place = middle[:, None] + (columns if sign > 0 else -1 - columns)[None, :]
                inside = columns[None, :] < sizes[:, None]
                matrix[inside] = raw[place[inside]]
            suffixes, prefixes = deep_shallow(right, after), deep_shallow(back, before)
            best, least = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            for o in range(left_width + 1):
                on = np.flatnonzero((low <= o) & (o <= high))
                if not len(on):
                    continue
                ahead, behind = runs_of(*suffixes, length - o)[on], runs_of(*prefixes, o)[on]
                same = np.unique(np.stack([group[on], ahead, behind]), axis=1, return_inverse=True)[1].ravel() if len(live) >= 1 << 21 else np.unique((group[on] << 42) | (ahead << 21) | behind, return_inverse=True)[1]
                hit = on[(np.bincount(same, weights=weight[on]) > 1)[same]]
                least[hit] = np.where(best[hit] == 0, o, least[hit])
                best[hit] = o + 1
            top[chosen[live]], bottom[chosen[live]] = best, least
        ends = np.cumsum([len(p) for p in parts])[:-1]
        return [squeeze(np.stack([a, b]).astype(np.uint16)) for a, b in zip(np.split(top[number], ends), np.split(bottom[number], ends), strict=True)]

    return merge


# The whole


def asked_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])


def given_of(answers: pa.Table) -> dict[int, list[bytes]]:
    given: dict[int, list[bytes]] = {}
    for kind, _, answer in sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "answer")), strict=True), key=lambda x: x[:2]):
        given.setdefault(kind, []).append(answer)
    return given


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = stage(rows.mapInArrow(blocker(block_bytes), TEXTS), "suffix-texts", "uncompressed")
    buckets = n_buckets(blocks)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                entries = Entries(anchors_of(row, length))

                def packed(a: int, b: int, entries: Entries = entries) -> tuple[bytes, bytes]:
                    context = pack(entries.context[a:b])
                    return pack_sorted(entries.key[a:b]), len(context).to_bytes(8, "little") + context + squeeze(entries.flags[a:b])

                yield from asked_rows(row["block"], [(0, entries.key, packed)], buckets)
                give_back()

    first = stage(answered(blocks.mapInArrow(ask_anchors, ASKED), lambda kind, keys, extras: merge_anchors(keys, extras)), "suffix-anchors", "uncompressed")

    def ask_cases(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return asked_schema().empty_table()
        give_back()
        row = left.to_pylist()[0]
        anchors = anchors_of(row, length)
        cases = Cases(anchors, Entries(anchors), given_of(right).get(0, []))
        return pa.Table.from_batches(asked_rows(row["block"], [(1, cases.key, cases.packed)], buckets), schema=asked_schema())

    asked = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_cases, ASKED)
    merge = merge_cases(length)
    second = stage(answered(asked, lambda kind, keys, extras: merge(keys, extras)), "suffix-cases", "uncompressed")

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        give_back()
        row, given = left.to_pylist()[0], given_of(right)
        anchors = anchors_of(row, length)
        cases = Cases(anchors, Entries(anchors), given.get(0, []))
        ranges = [np.frombuffer(expand(a), np.uint16).reshape(2, -1).astype(np.int64) for a in given.get(1, [])]
        top, bottom = np.concatenate(ranges, axis=1) if ranges else np.zeros((2, 0), np.int64)
        top, bottom = top[cases.number], bottom[cases.number]
        hit = top > 0
        at = anchors.at[cases.rows[hit]]
        change = np.zeros(len(anchors.text) + 1, np.int32)
        np.add.at(change, at - (top[hit] - 1), 1)
        np.add.at(change, at - bottom[hit] + length, -1)
        goes = np.cumsum(change[:-1]) > 0
        rows, text = [], anchors.text
        for doc_id, size, begin in zip(row["doc_ids"], row["sizes"], anchors.begins.tolist(), strict=True):
            own, gone = text[begin : begin + size], goes[begin : begin + size]
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = (own[~gone] if spans else own).tobytes()
            rows.append((doc_id, size, size - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return blocks.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finish, KEPT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE_SQL = {
    "op2_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d),
repeated AS (SELECT r, i FROM (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM starts) QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT r, i, (lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL OR i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200)::INT AS fresh FROM repeated),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
spans AS (SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, span),
edges AS (SELECT r, span, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last, row_number() OVER (PARTITION BY r ORDER BY a DESC) = 1 AS final FROM spans),
kept AS (SELECT e.r, string_agg(substr(h, 2 * last + 1, 2 * (a - last)) || CASE WHEN final THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS k, sum(b - a) AS n, count(*) AS spans FROM edges e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
""",
}
