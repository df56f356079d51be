"""Whole queries: what the operators give over the test tables, with SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from sigloom.plans import parsing, rollups

    return [rollups, parsing]


def core_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def core_oracles() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}


def open_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.plans.rollups import v01_all

    return v01_all(spark, sf_dir)
