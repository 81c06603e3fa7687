"""From raw documents to packed training sequences: five stages, each written to shared storage and read again.

Every stage works on all that the one before it kept.  Language ID drops documents without a recognised language; the
n-gram join keeps one document of each class linked by a Jaccard similarity of 0.8 of five-word shingles; decontamination
drops documents that contain a benchmark item; the secret scan keeps every document and redacts credentials that are no
widely copied examples; packing cuts all texts into training sequences.  All stages but the last return the columns of
`documents`.

Defined results: null and empty texts have no language and go in the first stage; texts of any length are judged and kept whole;
of classes of near duplicates the least id stays, of rows that share it the text with the least hash, once; rows without an id
are told apart by their texts; contaminated rows go with all rows of their id; repeated rows are one after the second stage;
empty tables give an empty result of the same columns; extra columns pass through the stages whatever their names, but for
packing, which gives pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, language, ngram_join, packing, secrets
from brindle.llm.shared import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.spoken_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(docs, F.col("doc_id"), F.col("source"))
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).withColumnRenamed("queue", "source").drop("ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The model, the joins and the tokeniser are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
