"""The pipeline's stages against brute-force versions on a small corpus."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from brindle.llm import packing
from brindle.llm.shared import stage

KEY = "Zk83jdQmPq02LsVxT7"


def tables(spark, folder) -> list[tuple]:
    rng = random.Random(11)
    vocabulary = {"en": ["the", "and", "with", "thing", "ring", "that"], "fr": ["que", "été", "leur", "eau", "ment", "oui"], "de": ["der", "und", "nicht", "schön", "keit", "ich"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(i, prose("en", 20)) for i in range(4)]
    rows = []
    for i in range(150):
        lang = ("en", "fr", "de")[i % 3]
        text = prose(lang, rng.randint(20, 90))
        if i % 29 == 0:
            text += " " + items[i % 4][1] + " " + prose("en", 5)
        if i % 17 == 0:
            text += f" token={KEY}"
        rows.append((i, text, lang if i % 11 else None, f"s{i % 5}" if i % 17 else "s0", len(text)))
    for i in range(150, 190):  # near and exact copies
        words = rows[i % 37][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), rows[i % 37][2], "s1", 0))
    rows += [(200, None, None, None, 0), (201, "", None, "s1", 0), (202, "12 34 !!", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = tables(spark, folder)
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, step in pipeline.STAGES:
        docs.append(stage(step(spark, docs[-1], folder), f"test-{name}"))
    return folder, items, docs


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_language_keeps_clean_documents(stages):
    before, after = texts(stages[2][0]), texts(stages[2][1])
    assert set(before) - set(after) == {200, 201, 202} and stages[2][1].columns == stages[2][0].columns


def test_near_duplicates(stages):
    before, after = texts(stages[2][1]), texts(stages[2][2])
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} or {tuple(t.lower().split())} for i, t in before.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in sets if find(i) == i} and len(after) < len(before)


def test_decontamination(stages):
    before, after = texts(stages[2][2]), texts(stages[2][3])
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda t: {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)}
    dirty = {i for i, t in before.items() for _, item in stages[1] if len(grams(item) & grams(t)) >= 0.8 * len(grams(item))}
    assert dirty and set(after) == set(before) - dirty


def test_secrets_are_redacted_and_nothing_else_changes(stages):
    before, after = texts(stages[2][3]), texts(stages[2][4])
    assert set(before) == set(after) and any(KEY in t for t in before.values())
    assert after == {i: t.replace(KEY, "[SECRET]") for i, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][4].collect())


def test_packing_holds_every_token_of_the_survivors(stages):
    survivors, encoder = texts(stages[2][4]), packing.Encoder()
    total: dict = defaultdict(int)
    for r in stages[2][5].collect():
        total[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == len(encoder.ids(survivors[r["doc_id"]])) + 1
    assert total == {i: len(encoder.ids(t)) + 1 for i, t in survivors.items()}


def test_run_gives_the_last_stage(spark, stages):
    pick = lambda df: sorted(tuple(r) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert pick(pipeline.run(spark, stages[0])) == pick(stages[2][5])


CLASHING = ["_key", "_drop", "_id", "_hash", "_hits", "_lang_pred", "lang_pred", "score", "queue", "rid", "spans", "component_id", "_0"]


def test_stages_keep_columns_of_any_name_and_rows_without_an_id(spark, stages):
    folder, items, docs = stages
    rows = docs[0].where("doc_id < 60 OR doc_id > 150")
    no_id = rows.where("doc_id IN (3, 29)").withColumn("doc_id", pipeline.F.lit(None).cast("long"))
    now = rows.unionByName(rows.where("doc_id IN (4, 5)")).unionByName(no_id)
    now = stage(now.select("*", *[pipeline.F.lit(c).alias(c) for c in CLASHING]), "test-clashing")
    first = now
    for name, step in pipeline.STAGES[:-1]:
        now = stage(step(spark, now, folder), f"test-{name}")
        assert now.columns == first.columns
    kept = now.collect()
    assert all(r[c] == c for r in kept for c in CLASHING)
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and None not in ids  # 3 and 29 stand for their copies, and 29 is contaminated
    assert 29 not in ids and {4, 5} <= set(ids)
    assert {r["doc_id"] for r in pipeline.STAGES[-1][1](spark, now, folder).collect()} == set(ids)


def test_stages_on_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in pipeline.STAGES:
        now = step(spark, now, str(tmp_path))
        assert now.count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0
