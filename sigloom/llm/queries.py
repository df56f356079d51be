"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigloom.llm import ann, decontaminate, divergence, langid, licenses, merkle, mixing, quality, secrets, simhash, suffix_dedup, topk, warc
from sigloom.llm.common import remainder
from sigloom.session import spread


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_docs(spark, sf_dir, "doc_id", "text"), with_text=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_docs(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_docs(spark, sf_dir, "doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_docs(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_docs(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_docs(spark, sf_dir, "doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir, "doc_id", "text", "source"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir, "doc_id", "text", "lang"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.proofs(_docs(spark, sf_dir, *merkle.COLUMNS), altered={"text": lower}, where=remainder("doc_id", 3) == 0, with_path=False)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir, "text", "lang", "source"))


def op13_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_topk": op7_topk,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_langid": op10_langid,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_ann": op13_ann,
}

ORACLES: dict[str, str] = {
    "op3_licenses": licenses.oracle_sql(),
    "op8_secrets": secrets.oracle_sql(),
    "op11_merkle": merkle.oracle_sql(),
    "op12_divergence": divergence.oracle_sql(),
    "op5_warc": """WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS n, sha256(COALESCE(html, '')) AS d FROM pages),
 f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
 SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
 FROM p LEFT JOIN f ON f.d = p.d""",
    "op7_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings),
 s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
 SELECT * FROM r WHERE rank <= 20""",
}
