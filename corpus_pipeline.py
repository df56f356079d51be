"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept and on the columns of ``documents``; other
columns are left out.  An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigloom.llm import decontaminate, langid, mixing, neardup, secrets
from sigloom.llm.common import work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Pooled probability from which a language counts as recognised.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language isn't recognised; a null language is filled in.

    So null and empty texts go; rows that repeat an id are judged each on their own.
    """
    found = langid.identify(docs.select(*COLUMNS), also=COLUMNS)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a similarity of 0.8 of five-word shingles.

    Null and empty texts are one group; rows that repeat id and text are one.
    """
    return neardup.deduplicated(docs.select(*COLUMNS), width=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.  Null and empty texts hold none; repeated rows are judged each."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; a null text stays null."""
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken: at least once, as the covering budget takes each source whole.

    A null source is one of its own; null and empty texts, of no words, are taken in the first epoch; repeated rows are all taken.
    """
    return mixing.mixture(docs.select(*COLUMNS))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing_sources),
]

#: The stages train and link; SQL can't express them.  tests/llm holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
