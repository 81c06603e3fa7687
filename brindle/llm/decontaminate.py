"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

DataFrame functions only.  Words are runs of letters and digits, lower-cased; shingles are five words.  Test items are
partitioned by size class (powers of two of their shingle count).  The MinHash sketch of an item is the m smallest of its
64-bit shingle hashes, with m set by its size class so that m > (1 - threshold) * n: a text that contains the wanted part
of an item then cannot miss the whole sketch, and must in fact hit at least m - floor((1 - threshold) * n) of it.  That bound
turns the sketch into a search without misses: documents probe it shingle by shingle inside the scan, only hits leave the
scan, and what passes the bound is verified by the item's shingles themselves, as text.

Defined results: null or empty texts and items of under five words have no shingles and match nothing; rows that share a
doc_id count as one document (a null doc_id is never reported) and repeated items (same item_id) as one item; an empty side gives an empty result; extra
columns are ignored; texts of any length are probed whole; shingles that an item repeats count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import fresh, identity, small, stage, table

WORDS = 5
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def bound_once(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of all five-word shingles, in text order, from hashes of single words."""

    def slide(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WORDS - 1), F.lit(0))), lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WORDS)]))

    return bound_once(F.transform(words_of(text), lambda w: F.xxhash64(w)), slide)


def shingle_texts(text: Column) -> Column:
    """The words of every five-word shingle, joined by a space."""

    def slide(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WORDS - 1), F.lit(0))), lambda first, i: F.concat_ws(" ", first, *[F.get(w, i + k) for k in range(1, WORDS)]))

    return bound_once(words_of(text), slide)


def sketches(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(item shingles: item_id, h, s, n; sketch: item_id, h, least hits)."""
    missing = 1 - threshold
    each = items.select("item_id", F.explode(shingle_texts(F.col("text"))).alias("s")).distinct()
    each = each.withColumn("h", F.xxhash64(*[F.xxhash64(F.split("s", " ")[k]) for k in range(WORDS)]))
    sized = each.groupBy("item_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("h")).alias("hashes"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    m = F.greatest(F.lit(16), (F.floor(upper * missing + 1e-9) + 1).cast("int"))
    kept = sized.select("item_id", "n", F.slice("hashes", F.lit(1), m).alias("sketch"))
    least = F.greatest(F.lit(1), F.size("sketch") - F.floor(F.col("n") * missing + 1e-9))
    return each.join(sized.select("item_id", "n"), "item_id"), kept.select("item_id", least.alias("least"), F.explode("sketch").alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment of at least `threshold`."""
    shingles, sketch = sketches(items, threshold)
    shingles, sketch = stage(shingles, "decontaminate-items"), stage(sketch, "decontaminate-sketch")
    texts = docs.select("doc_id", "text")
    probes = texts.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("h"))
    hits = probes.join(small(sketch), "h").groupBy("doc_id", "item_id").agg(F.countDistinct("h").alias("hits"), F.first("least").alias("least"))
    pairs = stage(hits.where(F.col("hits") >= F.col("least")).select("doc_id", "item_id"), "decontaminate-pairs")
    suspects = texts.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    exact = suspects.select("doc_id", F.explode(shingle_texts(F.col("text"))).alias("s")).join(small(shingles.select("item_id", "s", "n")), "s")
    shared = exact.groupBy("doc_id", "item_id").agg(F.countDistinct("s").alias("n_shared"), F.first("n").alias("n_item"))
    found = shared.join(pairs, ["doc_id", "item_id"], "left_semi").where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean_of(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Documents that contain no test item; rows with one id go together, rows without an id by their texts."""
    found = contained_items(docs.select(identity().alias("doc_id"), "text"), items, threshold)
    name = fresh(docs, "_drop")
    drop = stage(found.select(F.col("doc_id").alias(name)).distinct(), "decontaminate-drop")
    return docs.join(small(drop), identity() == F.col(name), "left_anti").select(*docs.columns)


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_benchmark_containment": op6_benchmark_containment}

ORACLE_SQL = {
    "op6_benchmark_containment": r"""
WITH item_words AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
item_shingles AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item_words),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
doc_words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
doc_shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc_words)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
""",
}
