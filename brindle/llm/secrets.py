"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for credential-shaped candidates.  The hash of each candidate's value is aggregated over the
whole corpus by distinct repositories and distinct owners: a value that many owners carry is a widely copied example,
a high-entropy value that only one or two owners carry looks like a live credential.  The verdict goes back to each span.
Bare high-entropy strings (no keyword, no known prefix) are candidates too, and become spans only when their ownership
says that they are owner-specific.

Defined results: null text counts as empty (a row with no spans); a null owner or repository is the owner or repository
named by the empty string; repeated rows each give a row; an empty table gives an empty result; extra columns are ignored; texts of any length are
scanned whole; spans that begin together come in the order of the kinds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import fresh, small, stage, table

KINDS = ("assign", "access", "hex", "bare")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Only runs this long are worth an entropy estimate.
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")

FOUND = (
    "rid long, doc_id long, text_hash long, repository string, owner string, "
    "spans array<struct<start:int,end:int,kind:int,value_start:int,value:string,entropy:double>>"
)


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of the three base kinds, in text order per kind.

    Maximal hex runs are found directly with their least length, which leaves the same matches as dropping short runs.
    Matches of the other kinds are dropped only after they have consumed their text.
    """
    found = [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2, m.start()) for m in HEX_RUN.finditer(text)]
    return found


def bare_matches(text: str, base: list[tuple[int, int, int, int]], least_entropy: float) -> list[tuple[int, int, int, int]]:
    """High-entropy strings of mixed character classes that no base span touches."""
    found = []
    for m in BARE.finditer(text):
        value = m[0]
        classes = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
        if classes == 3 and entropy(value) >= least_entropy and not any(s < m.end() and m.start() < e for s, e, _, _ in base):
            found.append((m.start(), m.end(), 3, m.start()))
    return found


def scanner(least_entropy: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value_start", pa.int32()), ("value", pa.string()), ("entropy", pa.float64())])
        for batch in batches:
            lists = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_matches(text)
                rows = []
                for start, end, kind, at in sorted(base + bare_matches(text, base, least_entropy), key=lambda x: (x[0], x[2])):
                    value = text[at:end]
                    rows.append({"start": start, "end": end, "kind": kind, "value_start": at, "value": hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32], "entropy": entropy(value)})
                lists.append(rows)
            ids = pa.array(range(rid, rid + len(lists)), pa.int64())
            rid += len(lists)
            yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id"), batch.column("text_hash"), batch.column("repository"), batch.column("owner"), pa.array(lists, pa.list_(span))], names=["rid", "doc_id", "text_hash", "repository", "owner", "spans"])

    return scan


def find_candidates(docs: DataFrame, repository: Column, owner: Column, least_entropy: float = 3.6) -> DataFrame:
    """One staged row per document with its candidate spans; `rid` identifies the row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
    )
    return stage(rows.mapInArrow(scanner(least_entropy), FOUND), "secrets-found")


def ownership(found: DataFrame, example_owners: int = 3, live_owners: int = 2, least_entropy: float = 3.0) -> DataFrame:
    """Per candidate value: distinct repositories and owners over the whole corpus, and the verdict.

    `example`: at least `example_owners` owners carry it.  `live`: at most `live_owners` do and its entropy is high.
    `weak`: owner-specific, but not credential-like.  Rows are first reduced to distinct (value, repository, owner).
    """
    each = found.select("repository", "owner", F.inline("spans")).select("value", "repository", "owner", "entropy")
    seen = each.groupBy("value", "repository", "owner").agg(F.max("entropy").alias("entropy"))
    counts = seen.groupBy("value").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.max("entropy").alias("entropy"))
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when((F.col("n_owners") <= live_owners) & (F.col("entropy") >= least_entropy), "live").otherwise("weak")
    return counts.withColumn("verdict", verdict)


def scan_secrets(docs: DataFrame, repository: Column, owner: Column, example_owners: int = 3) -> DataFrame:
    """Per document: all spans in text order with verdict and ownership counts.

    Columns: rid, doc_id, text_hash (xxhash64), spans array<struct<start, kind, end, value_start, verdict, n_owners, n_repositories>>.
    Base kinds always stay; a bare candidate stays only when its verdict is `live`.  The verdicts are staged, so that both
    sides of the join back are plain exchanges and a value that a third of all rows carry can be split.
    """
    found = find_candidates(docs, repository, owner)
    verdicts = stage(ownership(found, example_owners).select("value", "n_repositories", "n_owners", "verdict"), "secrets-owned")
    each = found.select("rid", F.inline("spans")).join(verdicts, "value")
    kept = each.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value_start", "verdict", "n_owners", "n_repositories"))).alias("spans"))
    empty = F.expr("array()").cast("array<struct<start:int,kind:int,end:int,value_start:int,verdict:string,n_owners:bigint,n_repositories:bigint>>")
    return found.select("rid", "doc_id", "text_hash").join(spans, "rid", "left").withColumn("spans", F.coalesce("spans", empty))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, repository: Column, owner: Column, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every credential value that is no widely copied example replaced by `mark`; all rows stay.

    A row's spans are joined back by doc_id and text hash, so repeated rows get the same treatment and rows that share only
    an id do not get each other's.
    """
    columns = docs.columns
    id_, hash_, hits_ = (fresh(docs, name) for name in ("_id", "_hash", "_hits"))
    scanned = scan_secrets(docs, repository, owner).withColumn("hits", F.filter("spans", lambda s: s["verdict"] != "example"))
    hits = scanned.where(F.size("hits") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.transform("hits", lambda s: F.struct(s["value_start"].alias("at"), s["end"].alias("end"))).alias(hits_))
    hits = small(stage(hits.groupBy(id_, hash_).agg(F.first(hits_).alias(hits_)), "secrets-hits"), 100_000)
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits[id_]) & (F.xxhash64(docs["text"]) == hits[hash_]), "left")
    # Cut points run left to right; overlapping spans (a hex run inside an assigned value) melt into one mark.
    state = F.aggregate(
        hits_,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["end"] > acc["at"],
            F.struct(
                F.when(s["at"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["at"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
                s["end"].alias("at"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return joined.withColumn("text", F.when(F.col(hits_).isNull(), F.col("text")).otherwise(state)).select(*columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a repository of its own, its `source` the owner."""
    docs = table(spark, sf_dir, "documents")
    out = scan_secrets(docs, F.col("doc_id"), F.col("source"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return out.select(
        "doc_id", *map(count, range(3)), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE_SQL: dict[str, str] = {}
