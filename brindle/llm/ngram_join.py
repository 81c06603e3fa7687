"""N-gram Jaccard join by T-occurrence search, and the classes of linked documents.

A document is the set of its distinct word n-grams; two link when their Jaccard similarity reaches `percent` / 100.

1. Equal sets are collapsed: every block asks for the least document with each of its set fingerprints.
2. Shingles get one order for all: by how many documents share their cell of a counting sketch, then by hash.  Blocks ask for
   the counts of their cells; a count is never too small, so a shingle whose cell was counted once is in no other set.
3. Two linked sets share one of the first n - ceil(t n) + 1 shingles of each (the shortest inverted lists), so only these
   lists have to meet, and of these only the shingles that are not surely alone.  A block joins its own documents of a list,
   and sends one document of each size class to the list's bucket.  Documents that share a list, directly or over others, are
   a family; all links lie inside families.  Texts and passages that many documents share come last in the order, so they
   seldom glue documents that do not link.
4. The sets of a family meet in one task, which answers queries by T-occurrence search over the inverted lists of its
   documents, as DivideSkip does it: the longest lists are set aside, a heap merges the short ones and skips what cannot reach
   the required overlap, what still can is looked up in the long lists by binary search, and exact Jaccard similarity decides.
5. Not every document of a family has to query.  After a few pivots have, the documents outside the largest class so far
   do: a pair inside that class needs no query, as only classes are asked for, and every other pair has a member that
   queries.  A family of more than FEW documents or PIECE shingles (very many near copies) is dealt over several tasks: some
   leaders meet every piece, then pieces of the documents outside the largest class meet every piece.  No link between
   classes is lost.

Defined results: documents without words have an empty set and link with nothing; with fewer than n words the whole sequence
is the one shingle; rows with the same doc_id count as linked, whatever their texts; a null id is an id like others, larger
than any; an empty table gives an empty result; extra columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.blocks import BLOCKS, Block, ask, asked_rows, make_blocks, n_buckets, signed, with_answers
from brindle.llm.shared import expand, fresh, identity, mix, pack, pack_sorted, small, squeeze, stage, table, unpack, unpack_sorted
from brindle.operators.graph import connected_components, discard

CELL, SET, PREFIX, STAR = 0, 1, 2, 3
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Shingles (8 bytes each, a few copies) and documents of a family that one task searches; larger ones are dealt over several.
PIECE, FEW = 1_500_000, 128
#: Documents that query first inside a task, and those of a large family that meet all of its pieces.
PIVOTS, LEADERS = 3, 16
#: The cost of a probe against that of a merged entry, in the rule for the number of long lists.
SKIP_COST = 0.01
#: Shingles take more room than words, so blocks are smaller here.
BLOCK_BYTES = 5 << 20
ACTIVE_SCHEMA = pa.schema(
    [
        ("block", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("vocabulary", pa.binary()),
        ("all_ids", pa.list_(pa.int64())), ("all_n", pa.list_(pa.int64())), ("all_first", pa.list_(pa.int64())),
        ("sent", pa.list_(pa.struct([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())]))),
    ]
)
#: Stands for a null id.
NULL_ID = (1 << 63) - 1
LISTED = "block long, doc long, first long"
ACTIVE = f"{BLOCKS}, all_ids array<long>, all_n array<long>, all_first array<long>, sent array<struct<bucket:int,block:long,kind:int,keys:binary,extra:binary>>"
SENT = "target long, family long, doc long, asks boolean, listed boolean, shingles binary"
LINKS = "a long, b long"


class Shingles:
    """Distinct shingle hashes of each document of a block, document by document, in hash order."""

    def __init__(self, block: Block, n: int):
        words = mix(block.hashes()[0])
        sizes, starts = block.sizes, block.starts
        whole = np.maximum(sizes - n + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), whole)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole) + starts[doc]
        every = self.hashed(words, block.tokens, at, n)
        # Documents one by one: their sorts are small, and together far cheaper than one of the whole block.
        ends = np.cumsum(whole)
        keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(sizes)
        for i, (a, b) in enumerate(zip((ends - whole).tolist(), ends.tolist(), strict=True)):
            if b > a:
                own = np.sort(every[a:b])
                fresh = np.empty(b - a, bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                keys[i] = own[fresh]
        for length in range(1, n):
            short = np.flatnonzero(sizes == length)
            for i, key in zip(short.tolist(), self.hashed(words, block.tokens, starts[short], length), strict=True):
                keys[i] = np.array([key], np.uint64)
        self.count = np.array([len(k) for k in keys], np.int64)
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.begin = np.cumsum(self.count) - self.count

    @staticmethod
    def hashed(words: np.ndarray, tokens: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * BASE + words[tokens[at + k]]
        return mix(value)

    def of(self, doc: int) -> np.ndarray:
        return self.key[self.begin[doc] : self.begin[doc] + self.count[doc]]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each document's set (0 where empty)."""
        out = []
        for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.key ^ salt), dtype=np.uint64)])
            out.append(mix(total[self.begin + self.count] - total[self.begin] + self.count.astype(np.uint64) * salt))
        return out[0], out[1]


def sets_of(block: Block, shingles: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (fingerprint, second) of the non-empty sets, least document of each, and each document's number (-1: empty)."""
    a, b = shingles.fingerprints()
    full = np.flatnonzero(shingles.count > 0)
    order = full[np.lexsort((b[full], a[full]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    start = np.flatnonzero(fresh)
    number = np.full(len(a), -1)
    number[order] = np.cumsum(fresh) - 1
    own = block.order_keys()[order]
    return a[order][start], b[order][start], np.minimum.reduceat(own, start) if len(start) else own, number


def sketch_bits(n_words: int) -> int:
    """Two to four cells a word: most shingles that occur once have a cell of their own."""
    return min(60, max(10, int(2 * n_words).bit_length()))


class Sketch:
    """Cells of the shingles of a block's different sets; equal sets of a block count once."""

    def __init__(self, shingles: Shingles, number: np.ndarray, bits: int):
        full = np.flatnonzero(number >= 0)
        self.sets = np.sort(full[np.unique(number[full], return_index=True)[1]])
        self.shift = np.uint64(64 - bits)
        counted = np.zeros(len(number), bool)
        counted[self.sets] = True
        self.mask = np.repeat(counted, shingles.count)
        self.cells, self.where, self.counts = np.unique(shingles.key[self.mask] >> self.shift, return_inverse=True, return_counts=True)


def first_questions(n: int, bits: int):
    def questions(block: Block):
        shingles = Shingles(block, n)
        a, b, least, number = sets_of(block, shingles)
        sketch = Sketch(shingles, number, bits)
        counts = np.minimum(sketch.counts, 255).astype(np.uint8)

        def packed_set(i: int, j: int) -> tuple[bytes, bytes]:
            second = pack(b[i:j])
            return pack_sorted(a[i:j]), len(second).to_bytes(8, "little") + second + pack(least[i:j])

        return [(CELL, sketch.cells << sketch.shift, lambda i, j: (pack_sorted(sketch.cells[i:j]), squeeze(counts[i:j]))), (SET, a, packed_set)]

    return questions


def merge_first(kind: int, keys: list[bytes], extras: list[bytes]) -> list[bytes]:
    """Cells: in how many sets their shingles are, by quarters of a power of two (0: once).  Sets: the least document that has each."""
    parts = [unpack_sorted(k) for k in keys]
    ends = np.cumsum([len(p) for p in parts])[:-1]
    if kind == CELL:
        distinct, where = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.frombuffer(b"".join(expand(e) for e in extras), np.uint8)
        total = np.bincount(where, weights=counts.astype(float), minlength=len(distinct))
        rank = (4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return [squeeze(x) for x in np.split(rank[where], ends)]
    n = [int.from_bytes(e[:8], "little") for e in extras]
    a = np.concatenate(parts)
    b = np.concatenate([unpack(e[8 : 8 + m]) for e, m in zip(extras, n, strict=True)])
    own = np.concatenate([unpack(e[8 + m :]) for e, m in zip(extras, n, strict=True)])
    order = np.lexsort((b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = np.empty(len(a), np.uint64)
    least[order] = np.minimum.reduceat(own[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    return [pack(x) for x in np.split(least, ends)]


class Ranked:
    """A block's shingles with their ranks, its sets' least documents, and the documents that stand for their set."""

    def __init__(self, block: Block, given: dict[int, list[bytes]], n: int, bits: int):
        self.shingles = Shingles(block, n)
        _, _, least, number = sets_of(block, self.shingles)
        sketch = Sketch(self.shingles, number, bits)
        self.rarity = np.zeros(len(self.shingles.key), np.uint8)
        self.rarity[sketch.mask] = np.frombuffer(b"".join(expand(a) for a in given.get(CELL, [])), np.uint8)[sketch.where]
        first = np.concatenate([unpack(a) for a in given.get(SET, [])]) if len(least) else least
        self.own = block.order_keys()
        self.first = np.where(number >= 0, first[number] if len(first) else self.own, self.own)
        # Of equal sets of a block the one that was counted stands, if its document is the least of all.
        known = {int(number[i]): i for i in sketch.sets.tolist()}
        stands = {int(number[i]): i for i in np.flatnonzero((number >= 0) & (self.first == self.own)).tolist()[::-1]}
        self.stands = np.array(sorted(stands.values()), np.int64)
        self.counted = np.array([known[int(number[i])] for i in self.stands.tolist()], np.int64)

    def prefixes(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, shingle) of the rarest shingles of the documents that stand for their set, without those that are alone."""
        s = self.shingles
        docs, keys = [], [np.zeros(0, np.uint64)]
        for doc, same in zip(self.stands.tolist(), self.counted.tolist(), strict=True):
            a, n = int(s.begin[same]), int(s.count[same])
            chosen = n - (percent * n + 99) // 100 + 1
            rarity, key = self.rarity[a : a + n], s.key[a : a + n]
            shared = np.flatnonzero(rarity)
            places = chosen - (n - len(shared))
            if places <= 0:
                continue
            if places < len(shared):
                # Keys are in hash order, so the stable sort by rank is the order by (rank, hash).
                shared = shared[rarity[shared].argsort(kind="stable")[:places]]
            keys.append(key[shared])
            docs.append(doc)
        return np.repeat(np.array(docs, np.int64), [len(k) for k in keys[1:]]), np.concatenate(keys)


def size_class(count: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of linked sets differ by one class at most."""
    return np.floor(np.log(np.maximum(count, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def stars(key: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that share a list with another, the least document of each one's run); rows sorted by list, size class, document.

    Sizes of linked sets are at most one class apart, so a list is cut where a class is missing.
    """
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] > kind[:-1] + 1))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    least = np.repeat(np.minimum.reduceat(doc, start), size) if len(key) else doc
    shared = np.flatnonzero(np.repeat(size, size) > 1)
    return shared, least[shared]


def list_rows(block: Block, ranked: Ranked, place: np.ndarray, key: np.ndarray, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a block sends to the inverted lists of its prefixes: stars of its own documents, and one of each size class."""
    doc, kind = ranked.own[place], size_class(ranked.shingles.count, percent)[place]
    order = np.lexsort((doc, kind, key))
    key, kind, doc = key[order], kind[order], doc[order]
    shared, least = stars(key, kind, doc)
    local = np.unique(np.stack([doc[shared], least]), axis=1) if len(shared) else np.zeros((2, 0), np.uint64)
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))) if len(key) else np.zeros(0, np.int64)
    key, kind, doc = key[first], kind[first], doc[first]

    def packed(i: int, j: int) -> tuple[bytes, bytes]:
        names, at = np.unique(doc[i:j], return_inverse=True)
        parts = (pack(names), pack(kind[i:j].astype(np.uint64)), pack(at.astype(np.uint64)))
        return pack_sorted(key[i:j]), np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)

    yield from asked_rows(block.block, [(PREFIX, key, packed)], buckets)
    if local.shape[1]:
        row = (block.block % buckets, block.block, STAR, pack(local[0]), pack(local[1]))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["bucket", "block", "kind", "keys", "extra"])


def meet_lists(rows: pa.Table) -> pa.Table:
    """Inverted lists of a bucket as stars: (block, document, least document of its run of size classes)."""
    found = []
    key, doc, kind, block = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64))
    for b, what, k, extra in zip(*(rows.column(c).to_pylist() for c in ("block", "kind", "keys", "extra")), strict=True):
        if what == STAR:
            own = unpack(k)
            found.append(np.stack([np.full(len(own), b), signed(own), signed(unpack(extra))]))
            continue
        ends = 24 + np.cumsum(np.frombuffer(extra[:24], "<u8").astype(np.int64))
        names, at = unpack(extra[24 : ends[0]]), unpack(extra[ends[1] : ends[2]]).astype(np.int64)
        key.append(unpack_sorted(k))
        doc.append(names[at])
        kind.append(unpack(extra[ends[0] : ends[1]]).astype(np.int64))
        block.append(np.full(len(at), b))
    key, doc, kind, block = (np.concatenate(x) for x in (key, doc, kind, block))
    order = np.lexsort((doc, kind, key))
    key, doc, kind, block = key[order], doc[order], kind[order], block[order]
    shared, least = stars(key, kind, doc)
    found.append(np.stack([block[shared], signed(doc[shared]), signed(least)]))
    each = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("block", "doc", "first"), each, strict=True)})


# T-occurrence search


class Lists:
    """Inverted lists over sets of shingles: shingle -> sorted numbers of the sets that have it.

    Shingles that the same sets have share one list, which then counts as often as the query has shingles of it.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.count = np.array([len(x) for x in sets], np.int64)
        key = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = key.argsort(kind="stable")
        key, members = key[order], np.repeat(np.arange(len(sets)), self.count)[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.keys, size = key[begin], np.diff(np.append(begin, len(key)))
        name = np.add.reduceat(mix(members.astype(np.uint64) + np.uint64(1)), begin) + size.astype(np.uint64) if len(key) else key
        _, where, self.of = np.unique(name, return_index=True, return_inverse=True)
        self.lists = [members[a : a + n].tolist() for a, n in zip(begin[where].tolist(), size[where].tolist(), strict=True)]
        self.length = size[where]

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """Sets whose Jaccard similarity with the query set reaches percent / 100 (DivideSkip).

        At least T = ceil(percent * |query| / 100) of the query's lists must hold a set.  The longest lists, of weight L below
        T by the rule of the method, are probed only; a set in none of the others cannot reach T.
        """
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == query if len(self.keys) else np.zeros(len(query), bool)
        least = -(-percent * len(query) // 100)
        if int(found.sum()) < least:
            return []
        lists, weights = np.unique(self.of[at[found]], return_counts=True)
        by_length = np.argsort(-self.length[lists], kind="stable")
        lists, weights = lists[by_length], weights[by_length]
        most = min(least - 1, int(least / (SKIP_COST * np.log2(float(self.length[lists[0]]) + 1) + 1)))
        n_long = int(np.searchsorted(np.cumsum(weights), most, side="right"))
        aside = int(weights[:n_long].sum())
        probed = [(self.lists[k], w) for k, w in zip(lists[:n_long].tolist(), weights[:n_long].tolist(), strict=True)]
        merged = [(self.lists[k], w) for k, w in zip(lists[n_long:].tolist(), weights[n_long:].tolist(), strict=True)]
        hits = []
        for number, seen in merge_skip(merged, least - aside):
            size = int(self.count[number])
            if 100 * min(size, len(query)) < percent * max(size, len(query)):
                continue
            needed, left = -(-percent * (len(query) + size) // (100 + percent)), aside
            for members, weight in probed:
                if seen >= needed or seen + left < needed:
                    break
                left -= weight
                place = bisect_left(members, number)
                if place < len(members) and members[place] == number:
                    seen += weight
            if seen >= needed:
                hits.append(number)
        return hits


def merge_skip(lists: list[tuple[list[int], int]], least: int) -> Iterator[tuple[int, int]]:
    """(number, weight of the lists that hold it) where that weight is at least `least`, by a heap over the lists' heads.

    When the lists at the least head weigh too little, more lists are taken off until just before they could weigh enough; no
    number below the next head can qualify, so all that were taken off skip to it.
    """
    heap = [(members[0], k, 0) for k, (members, _) in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        number, weight, taken = heap[0][0], 0, []
        while heap and heap[0][0] == number:
            taken.append(heapq.heappop(heap))
            weight += lists[taken[-1][1]][1]
        if weight >= least:
            yield number, weight
            goal = number + 1
        else:
            while heap and weight + lists[heap[0][1]][1] < least:
                taken.append(heapq.heappop(heap))
                weight += lists[taken[-1][1]][1]
            if not heap:
                return
            goal = heap[0][0]
        for _, k, at in taken:
            members = lists[k][0]
            place = bisect_left(members, goal, at)
            if place < len(members):
                heapq.heappush(heap, (members[place], k, place))


class Classes:
    """Union-find over numbers, with class sizes."""

    def __init__(self, n: int):
        self.above, self.size = list(range(n)), [1] * n

    def find(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            if self.size[i] < self.size[j]:
                i, j = j, i
            self.above[j] = i
            self.size[i] += self.size[j]


def family_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Enough links between the sets of one family for its classes: pivots query first, then all outside the largest class."""
    lists, classes, out = Lists(sets), Classes(len(sets)), []

    def query(i: int) -> None:
        for j in lists.search(sets[i], percent):
            if j != i and classes.find(i) != classes.find(j):
                out.append((i, j))
                classes.join(i, j)

    first = range(min(PIVOTS, len(sets)))
    for i in first:
        query(i)
    largest = classes.find(max(range(len(sets)), key=lambda i: classes.size[classes.find(i)]))
    for i in [i for i in range(len(first), len(sets)) if classes.find(i) != largest]:
        query(i)
    return out


def send_sets(blocks: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """The sets of requested documents (block, doc, family, target, asks, listed), addressed to the tasks that search them.

    Rows of a block with the same id and different texts each send their set.
    """
    schema = pa.schema([("target", pa.int64()), ("family", pa.int64()), ("doc", pa.int64()), ("asks", pa.bool_()), ("listed", pa.bool_()), ("shingles", pa.binary())])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block = Block.of(left.to_pylist()[0])
        shingles = Shingles(block, n)
        places: dict[int, list[int]] = {}
        for place, doc in enumerate(signed(block.order_keys()).tolist()):
            places.setdefault(doc, []).append(place)
        docs = right.column("doc").to_pylist()
        packed = {d: [pack_sorted(shingles.of(place)) for place in places[d]] for d in set(docs)}
        row = pa.array([i for i, d in enumerate(docs) for _ in packed[d]], pa.int64())
        columns = [right.column(c).combine_chunks().take(row) for c in ("target", "family", "doc", "asks", "listed")]
        return pa.Table.from_arrays([*columns, pa.array([x for d in docs for x in packed[d]], pa.binary())], schema=schema)

    return blocks.groupBy("block").cogroup(requests.groupBy("block")).applyInArrow(send, SENT)


def search_families(sent: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of order keys.  Where every set both asks and is listed, by pivots; else the asking ones query the listed."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("family", "ascending"), ("doc", "ascending")])
        family = rows.column("family").to_numpy()
        docs = rows.column("doc").to_numpy()
        asks, listed = (rows.column(c).to_numpy() for c in ("asks", "listed"))
        packed = rows.column("shingles").to_pylist()
        a, b = [], []
        start = np.flatnonzero(np.append(True, family[1:] != family[:-1]))
        for i, j in zip(start.tolist(), np.append(start[1:], len(family)).tolist(), strict=True):
            sets = [unpack_sorted(x) for x in packed[i:j]]
            own = docs[i:j]
            if asks[i:j].all() and listed[i:j].all():
                links = family_links(sets, percent)
            else:
                members = np.flatnonzero(listed[i:j])
                lists = Lists([sets[k] for k in members.tolist()])
                links = [(k, int(members[m])) for k in np.flatnonzero(asks[i:j]).tolist() for m in lists.search(sets[k], percent) if own[members[m]] != own[k]]
            a += [int(own[x]) for x, _ in links]
            b += [int(own[y]) for _, y in links]
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return sent.groupBy("target").applyInArrow(search, LINKS)


def hashed_target(*parts: str):
    """A task of its own: negative, so that it cannot meet the shared ones."""
    return F.xxhash64(*parts).bitwiseOR(F.lit(-(1 << 63)))


def first_requests(homes: DataFrame, buckets: int) -> DataFrame:
    """Small families share tasks; pieces of large ones have their own, and the family's leaders go to every piece.

    Leaders are about LEADERS documents of a family, by hash.  They tie the pieces' classes together, so that few documents
    stay outside the largest class; which ones they are has no influence on the result.
    """
    placed = homes.withColumn("piece", F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int"))
    target = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("family"), F.lit(buckets))).otherwise(hashed_target("family", "piece"))
    yes = F.lit(True)
    own = placed.select("block", "doc", "family", target.alias("target"), yes.alias("asks"), yes.alias("listed"))
    large = placed.where("pieces > 1")
    pivots = large.groupBy("family").agg(F.collect_set(F.when(F.col("leads"), F.struct("doc", "block"))).alias("p"), F.first("pieces").alias("pieces"))
    each = pivots.select("family", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "p").select("family", "piece", F.inline("p"))
    led = each.select("block", "doc", "family", hashed_target("family", "piece").alias("target"), yes.alias("asks"), yes.alias("listed"))
    return own.unionByName(led).distinct()


def second_requests(large: DataFrame, classes: DataFrame) -> DataFrame:
    """For families of several pieces: pieces of the documents outside the largest class meet every piece of the family."""
    joined = stage(large.join(classes, large["doc"] == classes["node"], "left").select("block", "doc", "family", "members", "pieces", F.coalesce("component", "doc").alias("class")), "join-large")
    counts = joined.groupBy("family", "class").agg(F.count("*").alias("n"))
    most = stage(counts.groupBy("family").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0"), "join-most")
    rows = joined.join(most, "family").withColumn("groups", F.ceil(F.col("outside") * F.col("pieces") / F.col("members")).cast("int"))
    piece, group = F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int"), F.pmod(F.xxhash64("doc"), F.col("groups")).cast("int")
    members = rows.select("block", "doc", "family", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(False).alias("asks"), F.lit(True).alias("listed"))
    asking = rows.where(F.col("class") != F.col("largest")).select("block", "doc", "family", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), group.alias("group"), F.lit(True).alias("asks"), F.lit(False).alias("listed"))
    both = members.unionByName(asking).groupBy("block", "doc", "family", "piece", "group").agg(F.max("asks").alias("asks"), F.max("listed").alias("listed"))
    return both.select("block", "doc", "family", hashed_target("family", "piece", "group").alias("target"), "asks", "listed")


def narrowed(block: Block, keep: np.ndarray) -> dict:
    """The columns of a block with only the documents `keep`."""
    starts = block.starts
    tokens = np.concatenate([block.tokens[starts[i] : starts[i] + block.sizes[i]] for i in keep.tolist()]) if len(keep) else np.zeros(0, np.int64)
    used, renumbered = np.unique(tokens, return_inverse=True)
    words = block.words
    return {"block": block.block, "n_tokens": len(tokens), "doc_ids": [block.doc_ids[i] for i in keep.tolist()], "sizes": block.sizes[keep].tolist(), "tokens": pack(renumbered.astype(np.uint32)), "vocabulary": squeeze(b" ".join([words[i] for i in used.tolist()]))}


def in_pieces(homes: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (block, doc, family) with the size of their family and the pieces it is dealt in."""
    members = homes.select("doc", "family").distinct().join(numbers, F.col("doc") == F.col("node"))
    sizes = members.groupBy("family").agg(F.count("*").alias("members"), F.greatest(F.ceil(F.sum("n") / PIECE), F.ceil(F.count("*") / FEW)).cast("int").alias("pieces"))
    leads = F.pmod(F.xxhash64(F.lit(1), F.col("doc")), F.col("members")) < LEADERS
    return stage(homes.join(stage(sizes, "join-sizes"), "family").select("block", "doc", "family", "members", "pieces", leads.alias("leads")), "join-homes")


def families_of(lists: DataFrame) -> DataFrame:
    """(block, doc, family): documents that share a list, directly or over others."""
    families = stage(classes := connected_components(lists.select(F.col("doc").alias("a"), F.col("first").alias("b"))), "join-families")
    discard(classes)
    found = stage(lists.select("doc", "block").distinct().join(families, F.col("doc") == F.col("node")).select("block", "doc", F.col("component").alias("family")), "join-known")
    discard(families)
    return found


def same_ids(rows: DataFrame) -> DataFrame:
    """Edges that tie the sets of rows with one id together; rows (own, first)."""
    several = rows.groupBy("own").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("own")
    return rows.join(several, "own").select(F.col("own").alias("a"), F.col("first").alias("b")).distinct()


def join_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n_shingles, first_id, component_id; links: a, b between least documents of sets)."""
    blocks = make_blocks(docs, lower=True, block_bytes=BLOCK_BYTES)
    buckets = n_buckets(blocks)
    bits = sketch_bits(blocks.agg(F.sum("n_tokens")).first()[0] or 0)
    first = stage(ask(blocks, first_questions(n, bits), merge_first), "join-first", "uncompressed")

    def reduce(block: Block, given: dict[int, list[bytes]]) -> pa.Table:
        """The block with only the documents that send to some list, what they send, and what is known of all its documents."""
        ranked = Ranked(block, given, n, bits)
        place, key = ranked.prefixes(percent)
        sent = [r for batch in list_rows(block, ranked, place, key, percent, buckets) for r in batch.to_pylist()]
        known = {"all_ids": block.doc_ids, "all_n": ranked.shingles.count.tolist(), "all_first": signed(ranked.first).tolist(), "sent": sent}
        row = narrowed(block, np.unique(place)) | known
        return pa.Table.from_arrays([pa.array([row[f.name]], f.type) for f in ACTIVE_SCHEMA], schema=ACTIVE_SCHEMA)

    reduced = stage(with_answers(blocks, first, reduce, ACTIVE, ACTIVE_SCHEMA), "join-active", "uncompressed")
    discard(blocks, first)
    sets = reduced.select("block", "n_tokens", "doc_ids", "sizes", "tokens", "vocabulary").where("n_tokens > 0")
    numbers = reduced.select(F.explode(F.arrays_zip("all_first", "all_n")).alias("d")).groupBy(F.col("d.all_first").alias("node")).agg(F.max("d.all_n").alias("n"))

    lists = stage(reduced.select(F.inline("sent")).groupBy("bucket").applyInArrow(meet_lists, LISTED), "join-lists")
    homes = in_pieces(families_of(lists), numbers)
    discard(lists)
    large = homes.where("pieces > 1")
    links = stage(search_families(send_sets(sets, first_requests(homes, buckets), n), percent), "join-links")
    if large.limit(1).count():
        classes = stage(connected_components(links), "join-classes")
        links = links.unionByName(stage(search_families(send_sets(sets, second_requests(large, classes), n), percent), "join-links"))

    each = reduced.select(F.explode(F.arrays_zip("all_ids", "all_n", "all_first")).alias("d")).select(F.col("d.all_ids").alias("doc_id"), F.col("d.all_n").alias("n_shingles"), F.col("d.all_first").alias("first"))
    tied = same_ids(each.where("n_shingles > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("own"), "first"))
    components = stage(connected_components(links.unionByName(tied)), "join-components")

    def as_id(key: str):
        return F.when(F.col(key) != NULL_ID, F.col(key))

    found = each.join(components, each["first"] == components["node"], "left").withColumn("root", F.coalesce("component", "first"))
    out = found.select("doc_id", "n_shingles", as_id("first").alias("first_id"), as_id("root").alias("component_id"))
    out.written_at = reduced.written_at + components.written_at  # for a caller that writes the classes and needs no links
    return out, links.select(as_id("a").alias("a"), as_id("b").alias("b")).distinct()


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The document with the least id of every class, once.

    Rows without an id have a key from their text, larger than usual ids; of rows that share a key one stays, of different
    texts the one with the least hash.
    """
    key, columns = fresh(docs, "_key"), docs.columns
    keyed = docs.withColumn(key, identity())
    classes = stage(found := join_documents(keyed.select(F.col(key).alias("doc_id"), "text"), n, percent)[0], "join-classes")
    discard(found)
    drop = stage(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "join-drop")
    several = stage(classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), "join-several")
    discard(classes)
    out = keyed.join(small(drop), key, "left_anti")
    if several.limit(1).count():
        least = F.min_by(F.struct(*[F.col(c) for c in columns]), F.xxhash64("text")).alias("row")
        once = out.join(small(several), key, "left_semi").groupBy(key).agg(least).select(F.inline(F.array("row")))
        return out.join(small(several), key, "left_anti").select(*columns).unionByName(once.select(*columns))
    return out.select(*columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))[0].drop("first_id")


QUERIES = {"op8_ngram_join": op8_ngram_join}
ORACLE_SQL = {
    "op8_ngram_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS grams FROM words),
each_gram AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM each_gram x JOIN each_gram y ON x.gram = y.gram AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
classes AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(grams) AS n_shingles, component_id FROM sets JOIN classes ON node = doc_id
""",
}
