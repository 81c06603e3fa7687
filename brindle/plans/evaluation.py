"""Evaluation over labels (quality as gold, toxic as prediction), conversations (roles as tags) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import evaluation as E
from brindle.plans.tables import read


def _span(category, when, confidence):
    one = F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit(category).alias("category"), confidence.alias("confidence"))
    return F.when(when, F.array(one)).otherwise(F.filter(F.array(one), lambda x: F.lit(False)))


def records(spark, d):
    """Two spans a document: gold says quality and (doc_id % 3 = 0), predictions say toxic and (doc_id % 3 < 2)."""
    labels, none = read(spark, d, "labels"), F.lit(None).cast("double")
    third = F.col("doc_id") % 3
    gold = F.concat(_span("quality", F.col("quality") == 1, none), _span("third", third == 0, none))
    found = F.concat(_span("quality", F.col("toxic") == 1, F.lit(0.75)), _span("third", third < 2, none))
    return labels.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("text"), gold.alias("ground_truth"), found.alias("predictions"))


def micro_prf(spark, d):
    return E.micro(E.confusion(records(spark, d)))


def confident_prf(spark, d):
    kept = records(spark, d).withColumn("predictions", E.confident(F.col("predictions"), 0.8))
    return E.micro(E.confusion(kept))


def error_filter(spark, d):
    return E.with_error(E.confusion(records(spark, d)), "FP").select("id", "tp", "fp", "fn")


def error_lists(spark, d):
    errors = E.confusion(records(spark, d)).select("id", F.posexplode("errors").alias("at", "error"))
    return errors.select("id", F.col("at").cast("long").alias("at"), "error.type", F.col("error.span.category").alias("category"))


def run_comparison(spark, d):
    old = records(spark, d)
    new = old.withColumn("predictions", F.when(F.col("id") % 2 == 0, F.col("ground_truth")).otherwise(F.col("predictions"))).withColumn("text", F.when(F.col("id") % 10 == 0, "changed").otherwise(F.col("text")))
    return E.compare_runs(old, new)


def acceptance(spark, d):
    p = (F.col("value") % 100) / 100
    scored = read(spark, d, "events").select(p.alias("probability"), ((1 - p) * 0.5).alias("runner_up"), (F.col("event_type") != "error").alias("known"), (F.col("user_id") % 11 == 0).alias("conflict"), (F.col("event_id") % 8 != 0).alias("right"))
    out = E.acceptance(scored)
    return out.select("examples", "accepted", "correct", *[F.round(c, 9).alias(c) for c in ("brier", "precision", "coverage", "precision_lower")])


def role_entities(spark, d):
    """Roles as tags: user opens or continues by turn parity, assistant is another category, system is outside."""
    tag = F.when(F.col("role") == "system", "O").when((F.col("role") == "user") & (F.col("turn") % 4 < 2), "B-person").when(F.col("role") == "user", "I-person").otherwise("I-machine")
    turns = read(spark, d, "conversations").select("conv_id", "turn", tag.alias("tag"))
    return E.bio_spans(turns, "conv_id", "turn", "tag")


def role_entities_folded(spark, d):
    tag = F.when(F.col("role") == "system", "O").when((F.col("role") == "user") & (F.col("turn") % 4 < 2), "B-person").when(F.col("role") == "user", "I-person").otherwise("I-machine")
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", tag.alias("tag")))).alias("t"))
    spans = turns.select("conv_id", E.bio_spans_of(F.transform("t", lambda x: x["tag"])).alias("s"))
    return spans.select("conv_id", F.inline("s")).select("conv_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "category")


def greedy_overlap(spark, d):
    """Spans of orders within a customer's year, kept greedily in order of key."""
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.dayofyear("o_orderdate").alias("start"), (F.dayofyear("o_orderdate") + 1 + F.col("o_orderkey") % 90).cast("int").alias("end"))
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "start", "end"))).alias("spans"))
    return lists.select("o_custkey", F.inline(E.disjoint(F.col("spans")))).select("o_custkey", "o_orderkey")


QUERIES = {
    "q_micro_prf": micro_prf,
    "q_confidence_threshold": confident_prf,
    "q_error_type_filter": error_filter,
    "q_error_lists": error_lists,
    "q_compare_runs": run_comparison,
    "q_wilson_brier": acceptance,
    "q_bio_decode": role_entities,
    "q_bio_decode_fold": role_entities_folded,
    "q_greedy_overlap": greedy_overlap,
}

_FLAGS = """g AS (SELECT doc_id AS id, (quality = 1)::INT AS gq, (doc_id % 3 = 0)::INT AS gt, (toxic = 1)::INT AS pq, (doc_id % 3 < 2)::INT AS pt FROM labels),
c AS (SELECT id, gq, gt, pq, pt, gq * pq + gt * pt AS tp, pq * (1 - gq) + pt * (1 - gt) AS fp, gq * (1 - pq) + gt * (1 - pt) AS fn FROM g)"""
_TAGS = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN role = 'system' THEN 'O' WHEN role = 'user' AND turn % 4 < 2 THEN 'B' ELSE 'I' END AS p,
  CASE WHEN role = 'system' THEN '' WHEN role = 'user' THEN 'person' ELSE 'machine' END AS category FROM conversations),
o AS (SELECT *, p <> 'O' AND NOT coalesce(p = 'I' AND lag(category) OVER w = category AND lag(p) OVER w <> 'O', false) AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM o)
SELECT conv_id, min(pos) AS start, max(pos) + 1 AS "end", any_value(category) AS category FROM r WHERE p <> 'O' GROUP BY conv_id, run"""
_PRF = "SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp) / sum(tp + fp) AS precision, sum(tp) / sum(tp + fn) AS recall, 2 * sum(tp) / sum(2 * tp + fp + fn) AS f1 FROM c"

ORACLE_SQL = {
    "q_micro_prf": f"WITH {_FLAGS} {_PRF}",
    "q_confidence_threshold": f"WITH {_FLAGS.replace('(toxic = 1)::INT', '0')} {_PRF}",
    "q_error_type_filter": f"WITH {_FLAGS} SELECT id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM c WHERE fp > 0",
    "q_error_lists": f"""WITH {_FLAGS}, e AS (SELECT id, 'FN' AS type, 'quality' AS category FROM c WHERE gq > pq UNION ALL SELECT id, 'FN', 'third' FROM c WHERE gt > pt
UNION ALL SELECT id, 'FP', 'quality' FROM c WHERE pq > gq UNION ALL SELECT id, 'FP', 'third' FROM c WHERE pt > gt)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY type, category) - 1 AS at, type, category FROM e""",
    "q_compare_runs": f"WITH {_FLAGS} SELECT id, (fp + fn)::BIGINT AS old_errors, (CASE WHEN id % 2 = 0 THEN 0 ELSE fp + fn END)::BIGINT AS new_errors, (CASE WHEN id % 2 = 0 THEN -(fp + fn) ELSE 0 END)::BIGINT AS delta, id % 10 <> 0 AS comparable FROM c",
    "q_wilson_brier": """WITH s AS (SELECT (value % 100) / 100 AS p, (1 - (value % 100) / 100) * 0.5 AS r, event_type <> 'error' AS known, user_id % 11 = 0 AS conflict, event_id % 8 <> 0 AS ok FROM events),
a AS (SELECT count(*) AS examples, count(*) FILTER (known AND p >= 0.9 AND p - r >= 0.15 AND NOT conflict) AS accepted, count(*) FILTER (known AND p >= 0.9 AND p - r >= 0.15 AND NOT conflict AND ok) AS correct, avg(pow(p - ok::INT, 2)) AS brier FROM s),
q AS (SELECT *, correct / accepted AS k FROM a)
SELECT examples, accepted, correct, round(brier, 9) AS brier, round(k, 9) AS precision, round(accepted / examples, 9) AS coverage,
round((k + 3.8416 / (2 * accepted) - 1.96 * sqrt(k * (1 - k) / accepted + 3.8416 / (4 * accepted * accepted))) / (1 + 3.8416 / accepted), 9) AS precision_lower FROM q""",
    "q_bio_decode": f"WITH {_TAGS}",
    "q_bio_decode_fold": f"WITH {_TAGS}",
}
