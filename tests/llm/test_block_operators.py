"""Window dedup, suffix dedup, n-gram join and interpolation against brute-force versions."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from brindle.llm import blocks, interpolation, ngram_join, suffix_dedup, window_dedup
from tests.llm.corpus import documents, empty, frame


def distinct_rows() -> list[tuple]:
    return list({r[0]: r for r in documents()}.values())


@pytest.mark.parametrize("length,depth", [(50, 2), (3, 1), (20, 3)])
def test_window_dedup(spark, monkeypatch, length, depth):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(window_dedup, "make_blocks", lambda docs, lower: blocks.make_blocks(docs, lower, 4000))
    rows = documents()
    first: dict = {}
    words = {r[0]: (r[1] or "").encode().split() for r in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    got = window_dedup.remove_repeats(frame(spark, rows), length, depth, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        own = words[r["doc_id"]]
        gone = np.zeros(len(own), bool)
        for k in range(len(own) - length + 1):
            if first[tuple(own[k : k + length])] < r["doc_id"]:
                gone[k : k + length] = True
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) == (len(own), gone.sum(), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert window_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("length,hot", [(200, 512), (40, 512), (40, 1), (7, 2)])
def test_suffix_dedup(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "PER_BLOCK", 64 if hot > 2 else 1)
    rows = documents()
    texts = [(r[1] or "").encode() for r in rows]
    count: Counter = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = []
    for row, text in zip(rows, texts):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        want.append((row[0], len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = suffix_dedup.remove_repeats(frame(spark, rows), length, with_text=True, block_bytes=6000).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("width", [3, 8, 20, 40])
def test_multikey_groups_sort_by_leading_bytes(width):
    rng = np.random.default_rng(width)
    rows = rng.choice([0, 1, 255], (500, width), p=[0.6, 0.3, 0.1]).astype(np.uint8)
    order = np.arange(500)
    start = suffix_dedup.multikey_groups(rows, order, 32)
    heads = [rows[i, :32].tobytes() for i in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(500))
    assert start.tolist() == [k for k in range(500) if k == 0 or heads[k] != heads[k - 1]]
    assert suffix_dedup.multikey_groups(rows[:0], np.arange(0), 32).tolist() == []


def test_deep_shallow_order_and_prefixes():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice([0, 1, 97], rng.integers(0, 60)).astype(np.uint8)) for _ in range(300)]
    texts += [t[:40] + b"zz" for t in texts[:80]] + texts[:40] + [b"", b"\0", b"\0\0"]
    rows = np.zeros((len(texts), 64), np.uint8)
    for i, t in enumerate(texts):
        rows[i, : len(t)] = np.frombuffer(t, np.uint8)
    sizes = np.array([len(t) for t in texts])
    for shallow in (8, 32):
        order, common = suffix_dedup.deep_shallow(rows, sizes, shallow)
        ordered = [texts[i] for i in order]
        for a, b, n in zip(ordered, ordered[1:], common[1:]):
            assert n == suffix_dedup.common_prefix(a, b)
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
        # Runs of equal prefixes are contiguous, which is what the intervals need.
        for depth in (1, 5, 20):
            run = suffix_dedup.runs_of(order, common, depth)
            long = [i for i in range(len(texts)) if sizes[i] >= depth]
            assert len({run[i] for i in long}) == len({texts[i][:depth] for i in long})


@pytest.mark.parametrize("piece,few", [(1_500_000, 256), (700, 256), (1_500_000, 6)])
def test_ngram_join(spark, monkeypatch, piece, few):
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    monkeypatch.setattr(ngram_join, "FEW", few)
    rows = documents()
    rows += [(-7, rows[9][1], "en", "s1", 0, "", "", "", "", ""), (-8, rows[9][1] + " end", "en", "s1", 0, "", "", "", "", "")]  # negative ids
    rng = np.random.default_rng(4)
    base = " ".join(f"k{i}" for i in rng.integers(0, 500, 120)).split()
    for i in range(40):  # a large group of near copies, some of them far from the first
        own = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 5)):
            own[p] = f"edit{rng.integers(0, 9)}"
        rows.append((500 + i, " ".join(own).title(), "en", "s1", 0, "", "", "", "", ""))
    sets = {}
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got, links = ngram_join.join_documents(frame(spark, rows, 4))
    result = got.collect()
    assert len(result) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in result} == {(i, len(sets[i]), find(i)) for i in ids}
    for r in links.collect():
        assert 100 * len(sets[r["a"]] & sets[r["b"]]) >= 85 * len(sets[r["a"]] | sets[r["b"]])
    assert ngram_join.join_documents(empty(spark))[0].count() == 0
    kept = ngram_join.one_of_each(frame(spark, rows, 2))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in ids if find(i) == i]


def test_ngram_join_shared_passages_do_not_link(spark, monkeypatch):
    """Long documents that share a passage are one family by its shingles, and fall apart when it is ordered by use."""
    monkeypatch.setattr(ngram_join, "FEW", 4)
    rng = np.random.default_rng(8)
    prose = lambda n, stem: " ".join(f"{stem}{i}" for i in rng.integers(0, 3000, n))
    passage = prose(60, "rare")
    texts = [f"{prose(150, 'w')} {passage} {prose(150, 'w')}" for _ in range(30)]
    texts += [texts[3] + " tail", texts[4] + " tail"]
    rows = [(i, t, "en", "s", 0, "", "", "", "", "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(frame(spark, rows, 3))[0].collect()}
    assert got == {i: {30: 3, 31: 4}.get(i, i) for i in range(len(rows))}


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 2, 3), (3, 2, 1, 0)])
def test_ngram_join_rows_that_share_an_id(spark, order):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a + " tail"), (9, b + " tail"), (3, None), (None, b + " more"), (11, "c d e f g h"), (11, "x y z"), (12, "c d e f g h"), (13, "x y z")]
    rows = [rows[i] for i in order] + rows[4:]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join_documents(docs)[0].collect()}
        assert got == {(5, 5), (7, 5), (9, 5), (3, 3), (None, 5), (11, 11), (12, 11), (13, 11)}
        kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()), key=str)
        assert [i for i, _ in kept] == [11, 3, 5] and kept[2][1] in (a, b)


def test_one_of_each_without_ids(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(None, text, "k"), (None, text, "k"), (None, text + " end", "k"), (None, "other words here that stand alone", "k"), (None, None, "k")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _key string"))
    assert kept.columns == ["doc_id", "text", "_key"]
    texts = sorted(str(r["text"]) for r in kept.collect())
    assert len(texts) == 3 and texts[0] == "None" and texts[1] in (text, text + " end") and texts[2].startswith("other")


def test_merge_skip_finds_all_that_weigh_enough():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lists = [(np.flatnonzero(rng.random(40) < rng.random()).tolist(), int(rng.integers(1, 4))) for _ in range(rng.integers(1, 9))]
        lists = [(m, w) for m, w in lists if m]
        for least in (1, 2, 5):
            weigh = {i: sum(w for m, w in lists if i in m) for i in range(40)}
            assert dict(ngram_join.merge_skip(lists, least)) == {i: w for i, w in weigh.items() if w >= least}


def test_interpolation(spark):
    rows = documents()
    got = interpolation.score_documents(frame(spark, rows)).collect()
    words = [(r[0], [*(r[1] or "").encode().lower().split(), b"\n"]) for r in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert interpolation.score_documents(empty(spark)).count() == 0
    untrained = frame(spark, [r for r in distinct_rows() if held(r[0])])
    assert {r["score"] for r in interpolation.score_documents(untrained).collect()} == {0.0}


def test_interpolation_weights_sum_and_use_context():
    events = np.array([[3, 0, 80, 90], [3, interpolation.LEVELS, 40, 10], [1, interpolation.LEVELS, 16, 50], [1, 8, 16, 1]])
    weights = interpolation.learn(events, 1000)
    assert weights.sum(axis=1) == pytest.approx(1.0) and weights[3, 0] > 0.8 and weights[1, 0] < 0.2 and weights[0, 0] == 0
