"""Listing lifecycle over orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import lifecycle as L
from brindle.plans.tables import read, sightings


def null_safe_antijoin(spark, d):
    """Orders not yet among the stored ones, with a price that is null for some: null matches null."""
    price = F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 50000))
    found = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), price.alias("price"))
    stored = read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("source"), price.alias("price"))
    return L.unseen(found, stored, ["source"], ["price"])


def semi_in_list(spark, d):
    keys = read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return read(spark, d, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


def sighting_status(spark, d):
    events = sightings(spark, d)
    seen = L.last_before(events, "listing", "ts", "event_id", F.when(~F.col("failed"), F.col("ts")), "last_seen")
    status = F.when(F.col("last_seen").isNull(), "unknown").otherwise(L.expiry(F.col("last_seen"), F.col("ts")))
    return seen.where("failed").select("event_id", "listing", status.alias("status"))


def latest_per_key(spark, d):
    return L.latest(sightings(spark, d), ["listing"], ["ts", "event_id"]).select("listing", "event_id", "event_type")


def first_fresh(spark, d):
    """The newest event per listing that is still fresh: the filter comes before the choice."""
    fresh = sightings(spark, d).where("NOT failed AND value >= 20")
    return L.latest(fresh, ["listing"], ["ts", "event_id"]).select("listing", "event_id")


def keep_first(spark, d):
    return L.latest(sightings(spark, d), ["listing", "event_type"], ["event_id"], last=False).select("listing", "event_type", "event_id")


def keep_last(spark, d):
    return L.latest(sightings(spark, d), ["listing", "event_type"], ["event_id"]).select("listing", "event_type", "event_id")


def insert_conflicts(spark, d):
    """Append events of the second half whose (listing, type) is new; of several new ones the first."""
    events = sightings(spark, d).select("event_id", "listing", "event_type")
    return L.insert_new(events.where("event_id % 2 = 1"), events.where("event_id % 16 = 0"), [["listing", "event_type"]], ["event_id"])


def upsert_pointer(spark, d):
    events = sightings(spark, d)
    old = L.latest(events.where("event_id % 2 = 0"), ["listing"], ["event_id"]).select("listing", "event_id")
    new = L.latest(events.where("event_id % 7 = 1"), ["listing"], ["event_id"]).select("listing", "event_id")
    return L.swap_pointer(old, new, "listing")


def optimistic_update(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "lang")
    updates = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), F.lit("xx").alias("lang")).where("doc_id % 2 = 0")
    return L.update_if_unchanged(docs, updates, "doc_id", "n_chars")[0]


def stale_updates(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "lang")
    updates = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), F.lit("xx").alias("lang")).where("doc_id % 2 = 0")
    return L.update_if_unchanged(docs, updates, "doc_id", "n_chars")[1].select("doc_id")


def scope_filter(spark, d):
    docs = read(spark, d, "documents").withColumn("rooms", (F.col("doc_id") % 6).cast("int"))
    return docs.where(L.in_scope(F.col("source"), F.col("rooms"), ["src1", "src2", "src7"], [2, 3]) | L.in_scope(F.col("source"), F.col("rooms"), [], [5])).select("doc_id", "source", "rooms")


def failure_runs(spark, d):
    return L.streaks(sightings(spark, d), "listing", ["ts", "event_id"], F.col("failed"), 2)


def kind_counts(spark, d):
    return sightings(spark, d).groupBy("listing").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), F.count_if(F.expr("event_type = 'click'")).alias("n_click"))


def duplicate_identities(spark, d):
    return sightings(spark, d).groupBy("listing", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("n > 3").select("listing", F.col("day").cast("string").alias("day"), "n")


def price_per_unit(spark, d):
    rows = read(spark, d, "lineitem")
    rate = L.price_per_area(F.col("l_extendedprice"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).otherwise(0.0))
    return rows.groupBy("l_returnflag").agg(F.round(F.avg(rate), 6).alias("rate"), F.count(rate).alias("n"), F.count("*").alias("n_all"))


def run_ids(spark, d):
    return sightings(spark, d).select("event_id", L.run_id("ad-selection", F.col("ts")).alias("run"))


QUERIES = {
    "q_null_safe_antijoin": null_safe_antijoin,
    "q_semi_in_list": semi_in_list,
    "q_sighting_status": sighting_status,
    "q_latest_per_key": latest_per_key,
    "q_first_fresh_per_key": first_fresh,
    "q_keep_first": keep_first,
    "q_keep_last": keep_last,
    "q_conflict_do_nothing": insert_conflicts,
    "q_upsert_pointer": upsert_pointer,
    "q_optimistic_update": optimistic_update,
    "q_stale_updates": stale_updates,
    "q_scope_filter": scope_filter,
    "q_failure_runs": failure_runs,
    "q_conditional_kind_counts": kind_counts,
    "q_duplicate_identity": duplicate_identities,
    "q_price_per_unit": price_per_unit,
    "q_run_id": run_ids,
}

_PRICE = "CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 50000)::BIGINT END"

ORACLE_SQL = {
    "q_null_safe_antijoin": f"""WITH f AS (SELECT o_orderkey AS id, o_custkey AS source, {_PRICE} AS price FROM orders),
s AS (SELECT o_custkey AS source, {_PRICE} AS price FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = f.source AND s.price IS NOT DISTINCT FROM f.price)""",
    "q_semi_in_list": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
    "q_sighting_status": """WITH s AS (SELECT event_id, user_id AS listing, ts, event_type,
max(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
SELECT event_id, listing, CASE WHEN seen IS NULL THEN 'unknown' WHEN seen < ts - INTERVAL 3 DAYS THEN 'expired' ELSE 'unreachable' END AS status FROM s WHERE event_type = 'error'""",
    "q_latest_per_key": "SELECT user_id AS listing, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q_first_fresh_per_key": "SELECT user_id AS listing, event_id FROM events WHERE event_type <> 'error' AND value >= 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q_keep_first": "SELECT user_id AS listing, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "q_keep_last": "SELECT user_id AS listing, event_type, max(event_id) AS event_id FROM events GROUP BY ALL",
    "q_conflict_do_nothing": """SELECT min(event_id) AS event_id, user_id AS listing, event_type FROM events e WHERE event_id % 2 = 1
AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 16 = 0 AND o.user_id = e.user_id AND o.event_type = e.event_type) GROUP BY user_id, event_type""",
    "q_upsert_pointer": """WITH o AS (SELECT user_id AS listing, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1),
n AS (SELECT user_id AS listing, max(event_id) AS event_id FROM events WHERE event_id % 7 = 1 GROUP BY 1)
SELECT coalesce(n.listing, o.listing) AS listing, coalesce(n.event_id, o.event_id) AS event_id FROM o FULL JOIN n ON o.listing = n.listing""",
    "q_optimistic_update": "SELECT doc_id, n_chars, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN 'xx' ELSE lang END AS lang FROM documents",
    "q_stale_updates": "SELECT doc_id FROM documents WHERE doc_id % 4 = 0",
    "q_scope_filter": "SELECT doc_id, source, (doc_id % 6)::INT AS rooms FROM documents WHERE (source IN ('src1', 'src2', 'src7') AND doc_id % 6 IN (2, 3)) OR doc_id % 6 = 5",
    "q_failure_runs": """WITH p AS (SELECT user_id AS listing, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY listing ORDER BY pos) AS island FROM p WHERE failed)
SELECT listing, count(*) AS length, min(pos) AS first_at, max(pos) AS last_at FROM g GROUP BY listing, island HAVING count(*) >= 2""",
    "q_conditional_kind_counts": "SELECT user_id AS listing, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, count(*) FILTER (event_type = 'click') AS n_click FROM events GROUP BY 1",
    "q_duplicate_identity": "SELECT user_id AS listing, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3",
    "q_price_per_unit": "SELECT l_returnflag, round(avg(l_extendedprice / l_quantity) FILTER (l_linenumber < 6 AND l_quantity > 0), 6) AS rate, count(*) FILTER (l_linenumber < 6 AND l_quantity > 0) AS n, count(*) AS n_all FROM lineitem GROUP BY 1",
    "q_run_id": "SELECT event_id, 'ad-selection-' || strftime(ts, '%Y%m%dT%H%M%SZ') AS run FROM events",
}
