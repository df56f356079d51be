"""Keyed tables without MERGE: idempotent append, upsert and dedupe; incremental selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in ``order``; a hash of all columns, as text, breaks ties.

    An aggregate, combined before the shuffle: a key of very many rows sends one from each task.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    rest = F.xxhash64(F.to_json(whole, {"ignoreNullFields": "false"}))
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order, rest)).alias("__x")).select("__x.*")


def append_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows to append: the first of each key that the target doesn't hold."""
    return first_per_key(rows, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")


def upserted(target: DataFrame, rows: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """The target after an upsert: a row for each key, the newer one's columns winning.

    ``merge`` gives a column from ``old`` and ``new`` instead, as ``F.greatest("old.x", "new.x")``.
    """
    merge = merge or {}
    fresh = F.col("__is_new")
    joined = target.alias("old").join(rows.withColumn("__is_new", F.lit(True)).alias("new"), keys, "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        return (merge[c] if c in merge else F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def latest_per_key(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of the greatest sequence number of each key."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.col(sequence)).alias("__x")).select("__x.*")


def unprocessed(rows: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    return rows.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


def mark_processed(signals: DataFrame, ids: DataFrame, key: str, at: Column) -> DataFrame:
    """``signals`` with ``processed_at`` set where the key is among ``ids`` and it was null."""
    seen = ids.select(F.col(key)).distinct().withColumn("__seen", F.lit(True))
    both = signals.join(seen, key, "left")
    return both.withColumn("processed_at", F.when(F.col("__seen") & F.col("processed_at").isNull(), at).otherwise(F.col("processed_at"))).select(*signals.columns)


def advance_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """(job, last_window_end): the later of both."""
    return old.unionByName(new).groupBy("job").agg(F.max("last_window_end").alias("last_window_end"))
