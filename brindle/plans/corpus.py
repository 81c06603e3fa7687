"""Corpus preparation: cleaning, hashes, duplicates, export report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import dedup
from brindle.operators.graph import written
from brindle.plans.tables import read

# SQL pieces that several statements share.
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"


def active_described(spark, d):
    """English documents stand for active listings."""
    return read(spark, d, "documents").where((F.col("lang") == "en") & F.col("text").isNotNull()).select("doc_id", "source")


def normalized_length_gate(spark, d):
    length = F.length(T.squeezed(F.col("text")))
    return read(spark, d, "documents").select("doc_id", length.cast("long").alias("chars")).where("chars >= 80")


def word_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", T.word_hash(F.col("text")).alias("hash"))


def spaced_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", T.spaced_hash(F.col("text")).alias("hash"))


def exact_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", T.exact_hash(F.col("text")).alias("hash"))


def exact_dedup(spark, d):
    return dedup.exact_survivors(read(spark, d, "documents"), "doc_id", "text")


def _noisy(spark, d):
    """Texts with something that cleaning must remove: a phone, a reference, invisible and decomposed letters, lines of signs."""
    k = (F.col("doc_id") % 5 + 1).cast("int")
    noise = F.element_at(
        F.array(
            F.lit("\nтел. 0888 123 456, +359-2-9876543 и 12345"), F.concat(F.lit(" Реф. номер: AB-"), F.col("doc_id").cast("string"), F.lit(" ref.no. X1 преф. № 7")), F.lit("\u200b не\u00advidimo e\u0301te\u0300\u00a0 \tдруго \n"),
            F.lit("\r\n *** \r\n\n\n\n https://x.org/a?b=1 край www.y.bg info@x-y.co.uk \r-"), F.lit(""),
        ),
        k,
    )
    return read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), noise).alias("text"))


def cleaned(spark, d):
    """Length and hash of cleaned texts."""
    return _noisy(spark, d).select("doc_id", T.clean_description(F.col("text")).alias("clean")).select("doc_id", F.length("clean").cast("long").alias("chars"), F.sha2("clean", 256).alias("hash"))


def _percentiles(lengths):
    """Positional percentiles from a histogram of `chars`: no global sort, and no list of all values."""
    sizes = lengths.groupBy("chars").agg(F.count("*").alias("n"))
    upto = Window.orderBy("chars").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sizes.withColumn("upto", F.sum("n").over(upto)).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total"))))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("chars"))).cast("long")
    return run.agg(at(F.floor(F.col("total") / 2)).alias("p50"), at(F.floor(F.col("total") * 0.95)).alias("p95"), F.max("chars").cast("long").alias("longest"))


def percentiles(spark, d):
    """Lengths of the rows that the export writes."""
    sizes = _percentiles(_export(spark, d).where("fate = 'written'").select("chars"))
    return sizes.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("p50", "p95", "longest")])


def top_areas(spark, d):
    docs = read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return docs.orderBy(F.desc("n"), "first").limit(15).select(F.concat_ws(" / ", "lang", "source").alias("area"), "n")


def _export(spark, d):
    rows = dedup.export(read(spark, d, "documents"), "doc_id", "text")
    return written(rows.select("doc_id", "fate", "poi_hint", F.col("char_count").cast("long").alias("chars")), "export")


def export_fates(spark, d):
    """What becomes of each document: short, exact copy, near copy or written."""
    return _export(spark, d).select("doc_id", "fate", "chars")


def export_counters(spark, d):
    """Counters of the export."""
    fate = lambda x: F.count_if(F.col("fate") == x)
    return _export(spark, d).agg(
        F.count("*").alias("listings_read"), fate("short").alias("dropped_too_short"), fate("exact").alias("dropped_exact_duplicate"), fate("near").alias("dropped_near_duplicate"),
        fate("written").alias("rows_written"), F.count_if((F.col("fate") == "written") & F.col("poi_hint")).alias("rows_with_poi_hint"),
    )


def duplicate_ids(spark, d):
    """For each text that stands, the ids of its exact copies in order."""
    return dedup.copies(dedup.exact_survivors(read(spark, d, "documents"), "doc_id", "text"), "doc_id").select("survivor", F.array_join(F.transform("copies", lambda x: x.cast("string")), ",").alias("copies"))


def cluster_numbers(spark, d):
    """Near-duplicate classes numbered in the order of their least documents."""
    return dedup.dense_numbers(dedup.near_duplicate_clusters(read(spark, d, "documents"), "doc_id", "text"), "doc_id")


def shingle_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


def near_pairs(spark, d):
    pairs = dedup.near_duplicate_pairs(read(spark, d, "documents"), "doc_id", "text")
    return pairs.select("a", "b", F.col("shared").cast("long").alias("shared"), F.round("jaccard", 9).alias("jaccard"))


def near_clusters(spark, d):
    return dedup.near_duplicate_clusters(read(spark, d, "documents"), "doc_id", "text")


def place_hints(spark, d):
    """Texts with and without something that hints at a place nearby."""
    k = (F.col("doc_id") % 6 + 1).cast("int")
    more = F.element_at(F.array(F.lit("до парка"), F.lit("на 5 мин пеша"), F.lit("тристаен"), F.lit("УЧИЛИЩЕ"), F.lit("молив и смола"), F.lit("мол")), k)
    return read(spark, d, "documents").select("doc_id", T.place_hint(F.concat(F.col("lang"), F.lit(" "), more, F.lit(" "), F.col("source"))).alias("hint"))


def slugs(spark, d):
    return read(spark, d, "nation").select("n_nationkey", T.slug(F.concat(F.lit("Южен  Щъркел Ж "), F.initcap("n_name"))).alias("slug"))


QUERIES = {
    "q_filter_active_described": active_described,
    "q_norm_length_gate": normalized_length_gate,
    "q_content_hash_word": word_hashes,
    "q_content_hash_ws": spaced_hashes,
    "q_exact_hash": exact_hashes,
    "q_exact_dedup_survivor": exact_dedup,
    "q_clean_description": cleaned,
    "q_positional_percentiles": percentiles,
    "q_top_areas": top_areas,
    "q_export_counters": export_counters,
    "q_export_fates": export_fates,
    "q_duplicate_ids": duplicate_ids,
    "q_cluster_numbers": cluster_numbers,
    "q_shingle_counts": shingle_counts,
    "q_near_dup_pairs": near_pairs,
    "q_near_dup_clusters": near_clusters,
    "q_place_hint": place_hints,
    "q_slugify": slugs,
}

_SETS = rf"""
hashed AS (SELECT doc_id, text, sha256(array_to_string({_WORDS}, ' ')) AS hash FROM documents),
standing AS (SELECT min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM hashed GROUP BY hash),
words AS (SELECT doc_id, {_WORDS} AS w FROM standing),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS grams FROM words),
each_gram AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, x.n AS n_a, y.n AS n_b
  FROM each_gram x JOIN each_gram y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2, 4, 5
  HAVING count(*) / (x.n + y.n - count(*)) >= 0.8)"""

_PHONE = r"(^|[^0-9+])(?:\+359|00359|0)(?:[\s\-./]?[0-9]){8,9}($|[^0-9])"
_REFERENCE = r"(?i)(^|[^\p{L}\p{N}_])(?:реф(?:ерентен)?\.?\s*(?:номер|№)|ref\.?\s*(?:no\.?|№))\s*[:.]?\s*\S+"
_TIDY = rf"""flat AS (SELECT doc_id, replace(replace(replace(regexp_replace(nfc_normalize(text), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{00AD}}]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ') AS t FROM noisy),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(?:https?://|www\.)\S+', '', 'g'), '{_EMAIL}', '', 'g'),
  '{_PHONE}', '\1\2', 'g'), '{_PHONE}', '\1\2', 'g'), '{_REFERENCE}', '\1', 'g') AS t FROM flat),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM plain),
tidy AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ' || chr(9)) AS line FROM lines),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM tidy WHERE line = '' OR regexp_matches(line, '[\p{{L}}\p{{N}}]') GROUP BY doc_id),
clean AS (SELECT d.doc_id, regexp_replace(regexp_replace(coalesce(body, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM noisy d LEFT JOIN joined USING (doc_id))"""
_CLEAN = f"""noisy AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'тел. 0888 123 456, +359-2-9876543 и 12345' WHEN 1 THEN ' Реф. номер: AB-' || doc_id || ' ref.no. X1 преф. № 7'
  WHEN 2 THEN chr(8203) || ' не' || chr(173) || 'vidimo e' || chr(769) || 'te' || chr(768) || chr(160) || ' ' || chr(9) || 'друго ' || chr(10)
  WHEN 3 THEN chr(13) || chr(10) || ' *** ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || ' https://x.org/a?b=1 край www.y.bg info@x-y.co.uk ' || chr(13) || '-' ELSE '' END AS text FROM documents), {_TIDY}"""

# The export on cleaned texts: the fate of every document.
_EXPORT = f"""noisy AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_TIDY},
hashed AS (SELECT doc_id, length(body) AS chars, body, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM clean),
long AS (SELECT *, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS survivor FROM hashed WHERE chars >= 80),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS grams FROM long WHERE doc_id = survivor),
each_gram AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM each_gram x JOIN each_gram y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.8),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
classes AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node),
fates AS (SELECT h.doc_id, h.chars, h.body, CASE WHEN h.chars < 80 THEN 'short' WHEN l.doc_id <> l.survivor THEN 'exact' WHEN c.cluster <> h.doc_id THEN 'near' ELSE 'written' END AS fate FROM hashed h LEFT JOIN long l USING (doc_id) LEFT JOIN classes c ON c.node = h.doc_id)"""
_HINT = (
    r"(?i)метро|спирк|трамва|автобус|училищ|гимназ|детск[аи] градин|университет|парк|(^|[^\p{L}\p{N}_])мол([^\p{L}\p{N}_]|$)|магазин|супермаркет|лидл|билла|"
    r"кауфланд|фантастико|болниц|аптек|фитнес|център|[0-9]+\s*(?:мин|м\.?([^\p{L}\p{N}_]|$)|км)|в близост|близо до|до\s+(?:бул|ул)\."
)

_CLUSTERS = f"""WITH RECURSIVE {_SETS},
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, other) AS (SELECT doc_id, doc_id FROM standing UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
classes AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node),
full_words AS (SELECT doc_id, hash, min(doc_id) OVER (PARTITION BY hash) AS survivor, len({_WORDS}) AS n FROM hashed)
SELECT f.doc_id, CASE WHEN f.n = 0 THEN f.doc_id ELSE c.cluster END AS cluster FROM full_words f JOIN classes c ON c.node = f.survivor"""

ORACLE_SQL = {
    "q_filter_active_described": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND text IS NOT NULL",
    "q_norm_length_gate": f"SELECT doc_id, length({_SQUEEZED}) AS chars FROM documents WHERE length({_SQUEEZED}) >= 80",
    "q_content_hash_word": f"SELECT doc_id, sha256(array_to_string({_WORDS}, ' ')) AS hash FROM documents",
    "q_content_hash_ws": f"SELECT doc_id, sha256({_SQUEEZED}) AS hash FROM documents",
    "q_exact_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "q_exact_dedup_survivor": f"""WITH h AS (SELECT doc_id, sha256(array_to_string({_WORDS}, ' ')) AS content_hash FROM documents)
SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS survivor FROM h""",
    "q_positional_percentiles": f"""WITH RECURSIVE {_EXPORT}, k AS (SELECT list(chars ORDER BY chars) AS v FROM fates WHERE fate = 'written')
SELECT v[len(v) // 2 + 1] AS p50, v[floor(len(v) * 0.95)::BIGINT + 1] AS p95, v[-1] AS longest FROM k""",
    "q_top_areas": "SELECT lang || ' / ' || source AS area, n FROM (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2 ORDER BY n DESC, f LIMIT 15)",
    "q_export_counters": f"""WITH RECURSIVE {_EXPORT} SELECT count(*) AS listings_read, count(*) FILTER (fate = 'short') AS dropped_too_short, count(*) FILTER (fate = 'exact') AS dropped_exact_duplicate, count(*) FILTER (fate = 'near') AS dropped_near_duplicate,
count(*) FILTER (fate = 'written') AS rows_written, count(*) FILTER (fate = 'written' AND regexp_matches(body, '{_HINT}')) AS rows_with_poi_hint FROM fates""",
    "q_export_fates": f"WITH RECURSIVE {_EXPORT} SELECT doc_id, fate, chars FROM fates",
    "q_duplicate_ids": f"""WITH h AS (SELECT doc_id, sha256(array_to_string({_WORDS}, ' ')) AS k FROM documents), g AS (SELECT min(doc_id) AS survivor, list(doc_id ORDER BY doc_id) AS ids FROM h GROUP BY k)
SELECT survivor, array_to_string(ids[2:], ',') AS copies FROM g WHERE len(ids) > 1""",
    "q_shingle_counts": f"""WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END::BIGINT AS n_shingles FROM words""",
    "q_near_dup_pairs": f"WITH {_SETS} SELECT a, b, shared, round(shared / (n_a + n_b - shared), 9) AS jaccard FROM pairs",
    "q_clean_description": f"WITH {_CLEAN} SELECT doc_id, length(body) AS chars, sha256(body) AS hash FROM clean",
    "q_near_dup_clusters": _CLUSTERS,
    "q_cluster_numbers": f"WITH c AS ({_CLUSTERS}) SELECT doc_id, cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS cluster_number FROM c",
    "q_place_hint": f"SELECT doc_id, regexp_matches(concat_ws(' ', lang, ['до парка', 'на 5 мин пеша', 'тристаен', 'УЧИЛИЩЕ', 'молив и смола', 'мол'][doc_id % 6 + 1], source), '{_HINT}') AS hint FROM documents",
    "q_slugify": "SELECT n_nationkey, 'yuzhen-shtarkel-zh-' || array_to_string(string_split(lower(n_name), ' '), '-') AS slug FROM nation",
}
