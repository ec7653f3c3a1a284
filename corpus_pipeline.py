"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage keeps all columns of documents, whatever more they have, and takes rows with null or empty texts, very long texts and
empty tables. Rows with a null doc_id are kept by the stages that drop documents by their id, and redacted and encoded as others.
Rows that repeat a doc_id are one document: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockweave.llm import decontam, minhash, secret_ledger, sentencepiece_scan, toxicity
from blockweave.llm.common import drop_staged, stage, staged
from blockweave.llm.labelled import training_rows


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.train(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
    return toxicity.without_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays. Rows without a doc_id stay."""
    gone = minhash.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    gone = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return secret_ledger.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return sentencepiece_scan.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("sentencepiece", encoded),
]

#: SQL can't express the classifier, the retrieval or the encoder; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        before = staged(spark)
        docs = stage(function(spark, docs, sf_dir), name)
        drop_staged(spark, [p for p in staged(spark)[:-1] if p not in before])  # the stage's own tables
    return STAGES[-1][1](spark, docs, sf_dir)
