"""URL filters: host and path rules first, then association rules mined by FP-growth from labelled URLs.

Main path: DataFrame functions and Spark's own FP-growth only.  The labelled URLs are the ones an explicit rule decides
(or any DataFrame of url and label).  Their token sets with the label as one more item are mined; rules `tokens => label` are
pruned by support and confidence, indexed under their rarest token, and matched against the URLs that no explicit rule fits.

Defined results: a null url, or one without `://`, has empty host and path and fits no explicit rule; it has no tokens, so
the method allows it.  Repeated rows each give a row; an empty table gives an empty result; extra columns are ignored; URLs of any length are read
whole; of rules of equal length, and of mined rules of equal confidence and support, the last by name decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import partitions, stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Mined rules up to this many are sent to every task; more are matched by a shuffled join.
BROADCAST_RULES = 20_000

#: (verdict, host, path) of the explicit rules that the query applies.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains, by labels."""
    return F.transform(F.array(F.split(host, r"\.", -1)), lambda p: F.transform(p, lambda _, i: F.array_join(F.slice(p, i + 1, F.size(p) - i), ".")))[0]


def explicit(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<length, rule, verdict>, or null.

    `rules` is a list that the caller wrote down, so its size is that of a configuration; it becomes a map literal looked up
    once for each parent domain, with no join.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append((rule_host + rule_path, rule_path, verdict))
    kind = "map<string,array<struct<rule:string,path:string,verdict:string>>>"
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    index = F.create_map(*[x for h, rows in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for r, p, v in rows]))]).cast(kind)
    fitting = F.flatten(F.filter(F.transform(suffixes(host), lambda s: F.try_element_at(index, s)), lambda x: x.isNotNull()))
    ranked = F.transform(F.filter(fitting, lambda r: F.startswith(path, r["path"])), lambda r: F.struct(F.length(r["rule"]).alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct URL tokens: scheme, host labels, path segments (numbers as #), extension, query keys, fragment."""
    scheme = F.concat(F.lit("scheme:"), F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    shaped = F.regexp_replace(path, "[0-9]+", "#")
    segments = F.transform(F.split(shaped, "/"), lambda x: F.concat(F.lit("path:"), x))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("([^&=]+)=?[^&]*"), 1), lambda x: F.concat(F.lit("query:"), x))
    mark = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.filter(F.concat(F.array(scheme), labels, segments, keys, mark), lambda x: ~F.endswith(x, F.lit(":"))))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.8) -> DataFrame:
    """Rules (antecedent array, label, confidence, support) from columns tokens and label."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("label="), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & F.startswith(F.col("consequent")[0], F.lit("label=")))
    rules = rules.where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("label="))))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring_index(F.col("consequent")[0], "=", -1).alias("label"), "confidence", "support")


def index_rules(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rules with `key`, the antecedent token that the fewest labelled URLs have."""
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    each = rules.withColumn("rule_id", F.xxhash64("antecedent", "label")).withColumn("token", F.explode("antecedent")).join(counts, "token")
    return each.groupBy("rule_id").agg(F.min_by("token", F.struct("count", "token")).alias("key"), F.first("antecedent").alias("antecedent"), F.first("label").alias("label"), F.first("confidence").alias("confidence"), F.first("support").alias("support")).drop("rule_id")


def judge(urls: DataFrame, index: DataFrame) -> DataFrame:
    """For rows (rid, tokens): the label of the best matching mined rule, by confidence, then support, then label."""
    found = index.select("key", "antecedent", "label", "confidence", "support")
    if index.count() <= BROADCAST_RULES:
        found = F.broadcast(found)
    each = urls.select("rid", "tokens", F.explode("tokens").alias("key")).join(found, "key")
    hits = each.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("rid").agg(F.max(F.struct("confidence", "support", "label")).alias("best")).select("rid", F.col("best.label").alias("mined"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = 0.005, confidence: float = 0.8) -> DataFrame:
    """Columns page_id, host, path, rule, verdict, confidence (of the mined rule, null elsewhere).

    Parsed URLs are staged once: mining, indexing and judging read narrow rows, and `rid` stays the same for all three.
    """
    url = F.col("url")
    parsed = pages.select("page_id", "url").withColumn("host", host_of(url)).withColumn("path", path_of(url))
    parsed = parsed.withColumn("hit", explicit(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(url, F.col("host"), F.col("path"))).withColumn("rid", F.monotonically_increasing_id())
    parsed = stage(parsed.select("rid", "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("label"), "tokens"), "urls")
    labelled = parsed.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select("tokens", "label")
    index = stage(index_rules(mine(labelled, support, confidence), labelled), "url-rules")
    parsed = parsed.repartition(partitions(pages.sparkSession), "rid")  # few files hold many URLs; both joins use this dealing
    mined = judge(parsed.where(F.col("label").isNull()), index)
    out = parsed.join(mined, "rid", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", "mined", F.lit("allow")).alias("verdict"), "confidence")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE_SQL: dict[str, str] = {}
