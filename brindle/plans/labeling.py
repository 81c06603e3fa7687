"""Labelling and dataset preparation over documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import dataset as D
from brindle.operators import labeling as L
from brindle.plans.tables import read


def _listings(spark, d):
    """Documents as listings: source is the area, n_chars the time of scraping."""
    return read(spark, d, "documents").select("doc_id", "source", "n_chars", "text")


def _tasks(spark, d):
    done = read(spark, d, "labels").select("doc_id")
    return _listings(spark, d).join(done, "doc_id").select("doc_id", T.spaced_hash(F.col("text")).alias("content_hash"))


def reserve(spark, d):
    out = L.reserve(_listings(spark, d), _tasks(spark, d), 40, "source", "n_chars", "doc_id", "text")
    return out.select("doc_id", "source", F.col("area_rank").cast("long").alias("area_rank"))


def unselected(spark, d):
    ledger = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "a").otherwise("b").alias("dataset"))
    return L.unselected(read(spark, d, "documents").select("doc_id", "source"), ledger, "a", "doc_id")


def seeded_sample(spark, d):
    return L.seeded_sample(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", "7", 0.05, 40)


def gold_bucket(spark, d):
    hashed = read(spark, d, "documents").select("doc_id", T.word_hash(F.col("text")).alias("h"))
    return hashed.select("doc_id", L.in_gold(F.col("h"), 15).alias("gold"))


def revision(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", L.annotation_revision(F.col("conv_id"), F.col("turn").cast("string")).alias("revision"))


def human_over_teacher(spark, d):
    """Turns of a conversation as labels of one text: users are human reviewers, the turn is the time."""
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("content_hash"), F.when(F.col("role") == "user", "human").otherwise("teacher").alias("label_source"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("annotated_at"), F.col("turn").alias("position"))
    return L.best_labels(rows).select("content_hash", "label_source", F.col("position").alias("turn"))


def _dataset(spark, d):
    """Labelled documents; equal words are one cluster; toxic documents are gold, quality says who reviewed."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "text", T.word_hash(F.col("text")).alias("cluster"))
    labels = read(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "text", "cluster", F.concat(F.col("cluster"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("content_hash"), F.when(F.col("toxic") == 1, "gold").otherwise("train").alias("split"), F.when((F.col("quality") == 1) | (F.col("toxic") == 1), "human").otherwise("teacher").alias("label_source"))


def split_clusters(spark, d):
    return D.split_by_cluster(_dataset(spark, d), 0.15, 42).select("doc_id", "assigned")


def coverage(spark, d):
    pois = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("park").alias("category")), F.struct(F.col("split").alias("category")))).otherwise(F.filter(F.array(F.struct(F.lit("park").alias("category"))), lambda x: F.lit(False)))
    rows = _dataset(spark, d).withColumn("tags", D.feature_tags(pois, F.col("text"), city=F.col("lang"), area=F.col("source")))
    return D.coverage(rows, "tags", "split")


def greedy_gold(spark, d):
    kinds = F.array_distinct(F.array(F.col("lang"), F.when(F.length("text") > 2000, "long").otherwise("short")))
    rows = _dataset(spark, d).select("content_hash", "cluster", kinds.alias("kinds"))
    chosen = sorted(D.select_gold(rows, 12, 42, exact=False))
    return spark.createDataFrame([(c,) for c in chosen], "content_hash string")


def leakage(spark, d):
    return D.leakage(read(spark, d, "documents").select(F.col("lang").alias("split"), "source", F.sha2("text", 256).alias("text_hash")), ("source", "text_hash")).groupBy("kind").agg(F.count("*").alias("n"))


def holdout(spark, d):
    """Bounds of the halves of each listing's events, and whether they are in order."""
    events = read(spark, d, "events").select("user_id", "ts", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("split"))
    ends = events.groupBy("user_id").agg(F.max(F.when(F.col("split") == "a", F.col("ts"))).alias("a"), F.min(F.when(F.col("split") == "b", F.col("ts"))).alias("b"))
    return ends.select("user_id", F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("ordered"))


def _tokens(docs):
    """Tokens of five characters over the whole of each document."""
    return docs.select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_chars").cast("long"), F.lit(5).cast("long"))).alias("position", "start")).withColumn("end", F.col("start") + 5)


def _owners(docs, begins):
    """Tokens that meet spans of nine characters, which begin at the offsets `begins` of each document."""
    spans = docs.select("doc_id", F.explode(begins).alias("begin")).withColumn("stop", F.col("begin") + 9).withColumn("category", F.lit("park"))
    owned = D.token_owners(_tokens(docs), spans, "doc_id")
    return owned.select("doc_id", F.col("position").cast("long").alias("position"), F.size("owners").cast("long").alias("owners"), F.col("owners")[0]["begin"].alias("first"))


def token_overlap(spark, d):
    """Spans from offset 3 to the end, 47 apart, and every third with another two characters on."""
    at = F.sequence(F.lit(3).cast("long"), F.greatest(F.col("n_chars"), F.lit(3)).cast("long"), F.lit(47).cast("long"))
    second = F.transform(F.filter(at, lambda x: x % 3 == 0), lambda x: x + 2)
    return _owners(read(spark, d, "documents").select("doc_id", "n_chars"), F.concat(at, second))


def metres(spark, d):
    unit = F.get(F.array(*map(F.lit, L.UNITS)), (F.col("doc_id") % 7).cast("int"))
    return read(spark, d, "documents").select("doc_id", L.estimated_metres((F.col("n_chars") % 50).cast("double"), unit).alias("metres"))


def poi_problems(spark, d):
    """The first and the last two words of each text as places: name, evidence and distance vary by id."""
    unit = F.get(F.array(*map(F.lit, L.UNITS)), (F.col("doc_id") % 7).cast("int"))
    value = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise((F.col("doc_id") % 5 - 1).cast("double"))

    def poi(words):
        name = F.when(F.col("doc_id") % 4 == 0, F.lower(words)).otherwise(words)
        return F.struct(F.lit("park").alias("category"), name.alias("name"), F.struct(value.alias("value"), unit.alias("unit")).alias("distance"), words.alias("evidence"))

    first, last = F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1), F.regexp_extract("text", r"(\S+\s+\S+)\s*$", 1)
    return read(spark, d, "documents").where(F.length(first) > 0).select("doc_id", F.size(L.problems(F.array(poi(first), poi(last)), F.col("text"))).cast("long").alias("n_problems"))


def reconcile(spark, d):
    """Turns as copies of a task: the same conversation is the same task."""
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("task_id"), (F.col("conv_id") / 2).cast("long").alias("labeling_task_id"), F.col("role").alias("data"), F.when((F.col("turn") == 2) & (F.col("role") == "assistant"), 1).otherwise(0).alias("n_annotations"))
    return L.reconcile(turns)


def batch_approval(spark, d):
    rows = read(spark, d, "conversations").select((F.col("conv_id") % 40).cast("string").alias("selection_batch_id"), F.when(F.col("turn") < 5, "synced").otherwise("failed").alias("sync_status"), F.when(F.col("role") != "system", F.lit("[]")).alias("human_result"))
    return L.approvable(rows)


def missing_tasks(spark, d):
    wanted = read(spark, d, "documents").select(F.col("doc_id").alias("labeling_task_id"))
    present = read(spark, d, "labels").select(F.col("doc_id").alias("labeling_task_id"))
    return L.missing_tasks(wanted, present)


def dataset_faults(spark, d):
    rows = read(spark, d, "documents").select(T.word_hash(F.col("text")).alias("content_hash"), F.when(F.col("lang") == "en", "human").otherwise("teacher").alias("label_source"), F.col("text").alias("description"))
    return D.row_faults(rows).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


QUERIES = {
    "q_reserve_stratified": reserve,
    "q_unselected_antijoin": unselected,
    "q_seeded_sample": seeded_sample,
    "q_gold_bucket_hash": gold_bucket,
    "q_annotation_revision": revision,
    "q_human_over_teacher": human_over_teacher,
    "q_split_by_cluster_order": split_clusters,
    "q_coverage_features": coverage,
    "q_greedy_gold": greedy_gold,
    "q_leakage_checks": leakage,
    "q_chrono_holdout": holdout,
    "q_token_span_overlap": token_overlap,
    "q_estimated_meters": metres,
    "q_poi_problems": poi_problems,
    "q_reconcile_tasks": reconcile,
    "q_batch_approval": batch_approval,
    "q_missing_tasks": missing_tasks,
    "q_dataset_faults": dataset_faults,
}

_HASH = r"sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' '))"
_SPACED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_ROWS = f"""rows_ AS (SELECT doc_id, lang, source, text, {_HASH} AS cluster, {_HASH} || '-' || lpad(doc_id::VARCHAR, 9, '0') AS content_hash,
CASE WHEN toxic = 1 THEN 'gold' ELSE 'train' END AS split, (quality = 1 OR toxic = 1) AS human FROM documents JOIN labels USING (doc_id))"""
_METRES = "CASE doc_id % 7 WHEN 0 THEN n_chars % 50 WHEN 1 THEN (n_chars % 50) * 1000 WHEN 2 THEN (n_chars % 50) * 80 WHEN 3 THEN (n_chars % 50) * 400 WHEN 4 THEN (n_chars % 50) * 250 WHEN 5 THEN (n_chars % 50) * 80 END::DOUBLE"

ORACLE_SQL = {
    "q_reserve_stratified": rf"""WITH h AS (SELECT doc_id, source, n_chars, {_SPACED} AS s, sha256({_SPACED}) AS k FROM documents),
t AS (SELECT doc_id, k FROM h JOIN labels USING (doc_id)),
o AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM t) AND k NOT IN (SELECT k FROM t) AND length(s) >= 80 QUALIFY row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) = 1),
r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS area_rank FROM o)
SELECT doc_id, source, area_rank FROM r ORDER BY area_rank, n_chars DESC, doc_id LIMIT 40""",
    "q_unselected_antijoin": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "q_seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id LIMIT (SELECT least(40, greatest(1, round_even(count(*) * 0.05, 0)))::BIGINT FROM documents)",
    "q_gold_bucket_hash": f"SELECT doc_id, ('0x' || substr(sha256('gold:' || {_HASH}), 1, 8))::BIGINT % 100 < 15 AS gold FROM documents",
    "q_annotation_revision": "SELECT conv_id, turn, ('0x' || substr(sha256(conv_id::VARCHAR || ':' || turn::VARCHAR), 1, 12))::BIGINT AS revision FROM conversations",
    "q_human_over_teacher": "SELECT conv_id AS content_hash, CASE WHEN role = 'user' THEN 'human' ELSE 'teacher' END AS label_source, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user') DESC, lpad(turn::VARCHAR, 4, '0') DESC, turn) = 1",
    "q_split_by_cluster_order": f"""WITH {_ROWS}, c AS (SELECT cluster, bool_or(split = 'gold') AS gold, bool_and(human) AS human, min(content_hash) AS least FROM rows_ GROUP BY cluster),
v AS (SELECT cluster FROM c WHERE NOT gold AND human ORDER BY sha256('42:' || least), cluster LIMIT (SELECT least(count(*) - 1, greatest(1, round_even(count(*) * 0.15, 0)))::BIGINT FROM c WHERE NOT gold))
SELECT doc_id, CASE WHEN gold AND split = 'gold' THEN 'gold' WHEN gold THEN 'excluded' WHEN cluster IN (SELECT cluster FROM v) THEN 'validation' ELSE 'train' END AS assigned FROM rows_ JOIN c USING (cluster)""",
    "q_coverage_features": f"""WITH {_ROWS}, f AS (SELECT split, unnest(list_distinct(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'category:park' ELSE 'no_pois' END, CASE WHEN doc_id % 3 = 0 THEN 'category:' || split END,
CASE WHEN length(text) >= 1500 THEN 'long_description' END, 'city:' || lang, 'area:' || source], lambda x: x IS NOT NULL))) AS feature FROM rows_) SELECT split, feature, count(*) AS n FROM f GROUP BY ALL""",
    "q_greedy_gold": f"""WITH RECURSIVE {_ROWS}, k AS (SELECT cluster, content_hash, list_position(['de', 'en', 'es', 'fr'], lang) AS a, CASE WHEN length(text) > 2000 THEN 5 ELSE 6 END AS b FROM rows_),
each_cluster AS (SELECT cluster, sha256('[42, "' || min(content_hash) || '"]') AS digest, list(a) AS la, list(b) AS lb FROM k GROUP BY cluster),
pick(step, chosen, n) AS (SELECT 0, []::VARCHAR[], [0, 0, 0, 0, 0, 0]::BIGINT[] UNION ALL
SELECT step + 1, list_append(chosen, x.cluster), list_transform(range(1, 7), lambda i: n[i] + len(list_filter(list_concat(x.la, x.lb), lambda y: y = i))) FROM pick, LATERAL (
  SELECT cluster, la, lb FROM each_cluster WHERE NOT list_contains(chosen, cluster)
  ORDER BY round(list_avg(list_transform(range(1, len(la) + 1), lambda j: (1 / (1 + n[la[j]]) + 1 / (1 + n[lb[j]])) / 2)), 9) DESC, digest LIMIT 1) x WHERE step < 12)
SELECT content_hash FROM k WHERE cluster IN (SELECT unnest(chosen) FROM pick WHERE step = 12)""",
    "q_leakage_checks": """SELECT 'source' AS kind, count(*) AS n FROM (SELECT source FROM documents GROUP BY 1 HAVING min(lang) <> max(lang)) HAVING count(*) > 0
UNION ALL SELECT 'text_hash', count(*) FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING min(lang) <> max(lang)) HAVING count(*) > 0""",
    "q_chrono_holdout": "SELECT user_id, coalesce(max(ts) FILTER (event_id % 2 = 0) < min(ts) FILTER (event_id % 2 <> 0), false) AS ordered FROM events GROUP BY 1",
    "q_token_span_overlap": """WITH t AS (SELECT doc_id, unnest(range(0, n_chars + 1, 5)) AS start FROM documents), b AS (SELECT doc_id, unnest(range(3, greatest(n_chars, 3) + 1, 47)) AS x FROM documents),
s AS (SELECT doc_id, x AS begin_ FROM b UNION ALL SELECT doc_id, x + 2 FROM b WHERE x % 3 = 0)
SELECT doc_id, start // 5 AS position, count(*) AS owners, min(begin_)::BIGINT AS first FROM t JOIN s USING (doc_id) WHERE start < begin_ + 9 AND start + 5 > begin_ GROUP BY doc_id, start""",
    "q_estimated_meters": f"SELECT doc_id, {_METRES} AS metres FROM documents",
    "q_poi_problems": r"""WITH w AS (SELECT doc_id, unnest([regexp_extract(text, '^\s*(\S+\s+\S+)', 1), regexp_extract(text, '(\S+\s+\S+)\s*$', 1)]) AS e, doc_id % 7 = 6 AS nearby, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 - 1 END AS v FROM documents WHERE regexp_matches(text, '\S\s+\S'))
SELECT doc_id, sum((NOT regexp_matches(CASE WHEN doc_id % 4 = 0 THEN lower(e) ELSE e END, '[\p{Nd}\p{Lu}]'))::INT + (nearby AND v IS NOT NULL)::INT + (NOT nearby AND v IS NULL)::INT + coalesce(v <= 0, false)::INT)::BIGINT AS n_problems FROM w GROUP BY doc_id""",
    "q_reconcile_tasks": """WITH t AS (SELECT conv_id * 100 + turn AS task_id, (conv_id // 2) AS labeling_task_id, role AS data, (turn = 2 AND role = 'assistant')::INT AS a FROM conversations)
SELECT labeling_task_id, arg_min(task_id, (1 - a) * 1000000000 + task_id) AS task_id, CASE WHEN count(DISTINCT data) > 1 THEN 'conflicting duplicates' WHEN sum(a) > 1 THEN 'several annotated duplicates' END AS fault FROM t GROUP BY labeling_task_id""",
    "q_batch_approval": """SELECT (conv_id % 40)::VARCHAR AS selection_batch_id, count(*) AS tasks, count(*) FILTER (turn < 5 AND role <> 'system') AS ready, bool_and(turn < 5 AND role <> 'system') AS approved FROM conversations GROUP BY 1""",
    "q_missing_tasks": "SELECT doc_id AS labeling_task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q_dataset_faults": f"""WITH h AS (SELECT {_HASH} AS k, lang, text FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h)
SELECT * FROM (SELECT 'repeated hash' AS fault, count(*) FILTER (n > 1) AS n FROM c UNION ALL SELECT 'not human', count(*) FILTER (lang IS DISTINCT FROM 'en') FROM c UNION ALL SELECT 'blank text', count(*) FILTER (trim(coalesce(text, '')) = '') FROM c) WHERE n > 0""",
}
