"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the documents of the next. All stages but the last return the columns of the documents. Every stage
learns from and judges exactly the rows its predecessor kept.

NULL and letterless texts have no language and go in the first stage; repeated rows stay together or go
together; an empty table passes through as an empty table; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleryloom.llm import bpe, decontaminate, langid, secrets, simhash
from galleryloom.llm.common import table
from galleryloom.session import materialize


def _recounted(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage changed it."""
    if "n_chars" not in before.columns:
        return after
    kind = dict(before.dtypes)["n_chars"]
    return after.withColumn("n_chars", F.length("text").cast(kind)).select(*before.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; texts without one (`und`) go."""
    return langid.keep_identified(docs, langid.fit(langid.training_rows(docs)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents that are mostly benchmark go."""
    return _recounted(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return _recounted(docs, secrets.redact(docs, *secrets.learn(docs)))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with digests of the ids and of the decoded bytes."""
    vocabulary = bpe.tokenizer()
    return bpe.encoded(docs, vocabulary, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

# The learned first and fourth stage have no SQL form; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table of documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
