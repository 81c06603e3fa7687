"""Names, areas and parsed pages over parts, suppliers, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import location as G
from brindle.operators import spatial as S
from brindle.plans.tables import read


def _places(spark, d):
    parts = read(spark, d, "part")
    return parts.select(F.lit("part").alias("dataset"), F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("name"), F.lower("p_brand").alias("category"), F.lit("").alias("settlement"), F.lit("").alias("number"))


def _no_aliases(spark):
    return spark.createDataFrame([], "old_name string, new_name string")


def name_match(spark, d):
    """Upper-cased, punctuated part names find all parts of the same brand with the same words."""
    asked = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mention_id"), F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("  "))), F.lit("!")).alias("name"), F.lower("p_brand").alias("category"))
    found = G.match_names(asked, _places(spark, d), _no_aliases(spark), fold=False)
    return found.where("quality = 1").select("mention_id", "external_id")


def name_match_fuzzy(spark, d):
    """Names with one letter doubled."""
    asked = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mention_id"), F.concat("p_name", F.substring("p_name", -1, 1)).alias("name"), F.lower("p_brand").alias("category"))
    return G.match_names(asked, _places(spark, d), _no_aliases(spark), fold=False).select("mention_id", "external_id", F.round("quality", 6).alias("quality"))


def _units(spark, side: int = 6):
    """Squares of 0.1 by 0.05 degrees."""
    ring = lambda x, y: [[x, y], [x + 0.1, y], [x + 0.1, y + 0.05], [x, y + 0.05], [x, y]]
    rows = [(f"u{i}{j}", [[[[float(round(v, 6)) for v in p] for p in ring(23.0 + 0.1 * i, 42.5 + 0.05 * j)]]]) for i in range(side) for j in range(side)]
    return spark.createDataFrame(rows, f"unit string, polygons {S.MULTIPOLYGON}")


def point_in_polygon(spark, d):
    """Events as points: value and user give the place; edges belong to both sides."""
    points = read(spark, d, "events").select("event_id", F.round(23.0 + (F.floor("value") % 60) * 0.01, 6).alias("x"), F.round(42.5 + (F.col("user_id") % 30) * 0.01, 6).alias("y"))
    return S.points_in_units(points, _units(spark)).select("event_id", "unit")


def support_mass(spark, d):
    """Every two neighbouring suppliers are one evidence region of two disks."""
    regions = read(spark, d, "supplier").select(F.concat(F.lit("g"), F.floor(F.col("s_suppkey") / 2).cast("string")).alias("group_key"), (23.05 + (F.col("s_suppkey") % 5) * 0.1).alias("x"), (42.52 + (F.col("s_suppkey") % 4) * 0.05).alias("y"), (F.lit(300.0) + F.col("s_suppkey") * 10).alias("radius_m"))
    return S.support(regions, _units(spark)).select("group_key", "unit", F.round("mass", 3).alias("mass"))


def _groups(spark, d):
    """Lines of an order as evidence groups: supplier is the unit, quantity the mass, shipping flags the kind.

    Weight and quality are decimals, so that their sums are exact in any order.
    """
    kind = F.when(F.col("l_returnflag") == "A", "address").when(F.col("l_returnflag") == "R", "street").otherwise("park")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").cast("string").alias("group_key"), kind.alias("kind"), (F.lit(1) + F.col("l_linenumber") % 3).cast("decimal(3,1)").alias("weight"), F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.85).cast("decimal(3,2)").alias("quality"), (F.lit(1) + F.col("l_partkey") % 3).cast("int").alias("n_places"), F.create_map((F.col("l_suppkey") % 7).cast("string"), F.col("l_quantity") / 50, (F.lit(7) + F.col("l_partkey") % 5).cast("string"), 1 - F.col("l_quantity") / 50).alias("support"))


def weighted_support(spark, d):
    ranked = G.rank_units(_groups(spark, d))
    return ranked.select("listing_id", "unit", F.round(F.col("features")[0], 9).alias("support"), F.round(F.col("features")[3], 9).alias("poi"), F.col("conflict"))


def top_vs_runner(spark, d):
    probable = G.probabilities(G.rank_units(_groups(spark, d)), G.WEIGHTS, 0.5)
    return G.accepted(probable).select("listing_id", "unit", F.round("probability", 6).alias("probability"), "accepted")


def union_of_sources(spark, d):
    """Three sources under one schema."""
    parts = read(spark, d, "part").select(F.lit("part").alias("dataset"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    suppliers = read(spark, d, "supplier").select(F.lit("supplier").alias("dataset"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    nations = read(spark, d, "nation").select(F.lit("nation").alias("dataset"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return parts.unionByName(suppliers).unionByName(nations)


def set_operations(spark, d):
    buyers = read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    rich = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    both = buyers.intersect(rich).withColumn("part", F.lit("both"))
    return both.unionByName(rich.subtract(buyers).withColumn("part", F.lit("idle"))).unionByName(buyers.subtract(rich).withColumn("part", F.lit("poor")))


def not_distinct(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("quality").eqNullSafe(F.col("toxic")).alias("same"), F.col("quality").eqNullSafe(F.lit(None).cast("int")).alias("unlabelled"))


def parsed_titles(spark, d):
    """Advertisement fields from made-up titles of parts."""
    raw = F.concat(F.lit("Продава "), (F.col("p_size") % 5 + 1).cast("string"), F.lit("-СТАЕН, "), F.floor("p_retailprice").cast("string"), F.lit(" 000 €, ет. "), (F.col("p_partkey") % 9).cast("string"), F.lit(" от "), (F.col("p_size") % 9 + 1).cast("string"), F.lit(" площад "), (F.col("p_size") * 2).cast("string"), F.lit(",5 кв.м"))
    parts = read(spark, d, "part").select("p_partkey", raw.alias("t"))
    return parts.select(
        "p_partkey", T.transaction_type(F.col("t")).alias("kind"), T.rooms(F.col("t")).cast("long").alias("rooms"), T.price(F.regexp_extract("t", r"\d+ 000 €", 0))["amount"].alias("amount"),
        T.floor(F.regexp_extract("t", r"ет\. .*", 0)).cast("long").alias("floor"), T.building_floors(F.col("t")).cast("long").alias("floors"), T.first_number(F.regexp_extract("t", "площад .*", 0)).alias("area"),
    )


def page_cards(spark, d):
    """Title, number of links and external id of raw pages."""
    pages = read(spark, d, "pages")
    title = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return pages.select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"<a [^>]*href="), 0)).cast("long").alias("links"), T.external_id(F.col("url")).alias("external_id"))


def page_links(spark, d):
    return read(spark, d, "pages").select("page_id", T.page_url(F.col("url"), F.lit(3)).alias("third"), T.safe_link(F.col("url")).isNotNull().alias("safe"))


QUERIES = {
    "q_name_match_exact": name_match,
    "q_name_match_fuzzy": name_match_fuzzy,
    "q_point_in_polygon": point_in_polygon,
    "q_support_mass": support_mass,
    "q_weighted_support": weighted_support,
    "q_top_vs_runner": top_vs_runner,
    "q_union_all_sources": union_of_sources,
    "q_set_ops": set_operations,
    "q_is_not_distinct": not_distinct,
    "q_parse_price_floor_rooms": parsed_titles,
    "q_html_cards": page_cards,
    "q_page_links": page_links,
}

_MASS = """g AS (SELECT l_orderkey AS listing_id, l_linenumber AS k, CASE l_returnflag WHEN 'A' THEN 'address' WHEN 'R' THEN 'street' ELSE 'park' END AS kind, 1.0 + l_linenumber % 3 AS w,
CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.85 END AS q, 1 + l_partkey % 3 AS places, l_quantity / 50 AS m, l_suppkey % 7 AS a, 7 + l_partkey % 5 AS b FROM lineitem),
c AS (SELECT listing_id, k, kind, w, q, places, a::VARCHAR AS unit, m AS mass FROM g UNION ALL SELECT listing_id, k, kind, w, q, places, b::VARCHAR, 1 - m FROM g),
t AS (SELECT listing_id, sum(w * q) AS total, count(*) FILTER (q >= 0.9) AS strong FROM g GROUP BY 1),
s AS (SELECT listing_id, max(n) AS most FROM (SELECT listing_id, unit, count(DISTINCT k) AS n FROM c WHERE q >= 0.9 AND mass >= 0.1 GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT listing_id, unit, sum(w * q * mass) AS support, coalesce(max(mass * q) FILTER (kind = 'address'), 0) AS address, coalesce(max(mass * q) FILTER (kind = 'street'), 0) AS street, coalesce(max(mass * q) FILTER (kind = 'park'), 0) AS poi,
count(*) FILTER (mass > 0.1) AS votes, coalesce(sum(1 / greatest(1, places)) FILTER (mass > 0.1), 0) AS branches, coalesce(max(q) FILTER (mass > 0.1), 0) AS quality FROM c GROUP BY 1, 2),
r AS (SELECT x.listing_id, unit, support / total AS support, address, street, poi, least(votes / 3, 1) AS independent, strong >= 2 AND coalesce(most, 0) < strong AS conflict, 1 - branches / greatest(votes, 1) AS ambiguity, quality FROM x JOIN t USING (listing_id) LEFT JOIN s USING (listing_id))"""

ORACLE_SQL = {
    "q_name_match_exact": "SELECT a.p_partkey::VARCHAR AS mention_id, b.p_partkey::VARCHAR AS external_id FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND lower(a.p_brand) = lower(b.p_brand)",
    "q_point_in_polygon": """WITH p AS (SELECT event_id, floor(value)::BIGINT % 60 AS x, user_id % 30 AS y FROM events), u AS (SELECT i, j FROM range(6) a(i), range(6) b(j))
SELECT event_id, 'u' || i || j AS unit FROM p JOIN u ON x BETWEEN i * 10 AND i * 10 + 10 AND y BETWEEN j * 5 AND j * 5 + 5""",
    "q_weighted_support": f"WITH {_MASS} SELECT listing_id, unit, round(support, 9) AS support, round(poi, 9) AS poi, conflict FROM r",
    "q_top_vs_runner": f"""WITH {_MASS}, f AS (SELECT listing_id, unit, conflict, 3 * support + 2 * address + 0.8 * street + 0.8 * poi + 0.5 * independent - 3 * conflict::INT - ambiguity + 0.5 * quality AS score FROM r),
o AS (SELECT listing_id, unit, conflict, exp(score / 0.5) AS e, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, unit) AS pos FROM f UNION ALL SELECT DISTINCT listing_id, NULL, conflict, 1.0, 1000 FROM f),
p AS (SELECT listing_id, unit, conflict, e / sum(e) OVER (PARTITION BY listing_id) AS p, row_number() OVER (PARTITION BY listing_id ORDER BY e DESC, pos) AS place FROM o),
z AS (SELECT listing_id, max(unit) FILTER (place = 1) AS unit, max(p) FILTER (place = 1) AS p, max(p) FILTER (place = 2) AS r, bool_or(conflict) AS conflict FROM p GROUP BY 1)
SELECT listing_id, unit, round(p, 6) AS probability, unit IS NOT NULL AND p >= 0.9 AND p - r >= 0.15 AND NOT conflict AS accepted FROM z""",
    "q_union_all_sources": "SELECT 'part' AS dataset, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation",
    "q_set_ops": """WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT k, 'both' AS part FROM (SELECT k FROM b INTERSECT SELECT k FROM r) UNION ALL SELECT k, 'idle' FROM (SELECT k FROM r EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'poor' FROM (SELECT k FROM b EXCEPT SELECT k FROM r)""",
    "q_is_not_distinct": "SELECT d.doc_id, l.quality IS NOT DISTINCT FROM l.toxic AS same, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "q_parse_price_floor_rooms": "SELECT p_partkey, 'sale' AS kind, (p_size % 5 + 1)::BIGINT AS rooms, (floor(p_retailprice) * 1000)::DOUBLE AS amount, (p_partkey % 9)::BIGINT AS floor, (p_size % 9 + 1)::BIGINT AS floors, (p_size * 2 + 0.5)::DOUBLE AS area FROM part",
    "q_html_cards": r"""SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS links,
CASE WHEN regexp_matches(url, '/obiava-[a-z0-9]+') THEN regexp_extract(url, '/obiava-([a-z0-9]+)', 1) ELSE string_split(regexp_replace(url, '/+$', ''), '/')[-1] END AS external_id FROM pages""",
    "q_page_links": r"""SELECT page_id, regexp_replace(regexp_extract(url, '^[^?#]*'), '/+$', '') || '/p-3' || substr(url, length(regexp_extract(url, '^[^?#]*')) + 1) AS third, regexp_matches(url, '^https?://[^/@?#]+([/?#]|$)') AS safe FROM pages""",
}
