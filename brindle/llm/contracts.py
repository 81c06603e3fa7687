"""The columns of the corpus queries that plain SQL can state too, taken from the operators' own results.

The full results hold what only the method gives (scores, verdicts, stored forms); what is fixed beside it is compared here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import interpolation, language, media, secrets, url_rules


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interpolation.op1_deleted_interpolation(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), (F.col("score") < 0).alias("negative"))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op5_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "error")


def language_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.op7_language_crf(spark, sf_dir)
    return out.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("und"), F.col("score").between(0, 1).alias("in_range"))


def url_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.op10_url_filter(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES = {"contract_lm_base": lm_base, "contract_secret_spans": secret_spans, "contract_media_payloads": media_payloads, "contract_language_scope": language_scope, "contract_url_decisions": url_decisions}


def crc32(octets: str) -> str:
    """CRC-32 of a list of bytes: the reflected polynomial, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295)"


_ID = crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)")
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans(kind: str, number: int, pattern: str, keep: str) -> str:
    """Rows (doc_id, kind, start, end) of all matches, from the pieces between them."""
    return rf"""{kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM texts),
{kind}_e AS (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m),
{kind}_s AS (SELECT doc_id, {number} AS kind, m[i] AS hit, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start FROM {kind}_e),
{kind} AS (SELECT doc_id, '{kind}' AS name, kind, start, start + length(hit) AS stop FROM {kind}_s WHERE {keep})"""


_ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+"

ORACLE_SQL = {
    "contract_lm_base": rf"""WITH w AS (SELECT doc_id, {_ID} % 7 = 2 AS held, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), chr(10)) AS t FROM documents),
tokens AS (SELECT doc_id, held, unnest(t) AS t FROM w), counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held GROUP BY t), total AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1)))), 6) AS base_score, true AS negative
FROM tokens LEFT JOIN counts USING (t), total GROUP BY doc_id""",
    "contract_secret_spans": rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", 0, _ASSIGN, r"length(regexp_extract(hit, '[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6")}, {_spans("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 20")}, {_spans("hex", 2, "[0-9a-f]+", "length(hit) >= 24")},
every AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')) AS base_sha256
FROM documents d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id""",
    "contract_media_payloads": rf"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, length(h) // 2 AS n, h || repeat('00', CASE WHEN h = '' THEN 64 ELSE (64 - (length(h) // 2) % 64) % 64 END) AS p FROM h)
SELECT doc_id, n AS n_bytes, length(p) // 2 AS payload_bytes, sha256(unhex(p)) AS payload_sha256, {crc32("list_transform(range(64), lambda i: ('0x' || substr(right(p, 128), 2 * i + 1, 2))::BIGINT)")} AS tail_crc32, NULL::VARCHAR AS error FROM p""",
    "contract_language_scope": rf"""SELECT doc_id, {_ID} % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS und, true AS in_range FROM documents""",
    "contract_url_decisions": r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(ruled, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(ruled, length(h || p)) AS ruled FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, ruled FROM u LEFT JOIN f USING (page_id)""",
}
