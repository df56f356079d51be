"""Keyed tables that take upserts without a shuffle of what they hold, and entity profiles kept in them.

A table is Spark's own: partitioned by a hash of its keys, or of some of them, and bucketed by the keys.  An upsert shuffles the new rows
to the buckets, joins them with the partitions that they fall in and overwrites those alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigloom.operators import features as X
from sigloom.operators.state import upserted
from sigloom.params import DEFAULT, Compat
from sigloom.storage import exists


@dataclass
class KeyedTable:
    """A table at ``path`` with the columns of the DDL text ``columns``, one row for each of ``keys``.

    ``by`` are the keys that the partition follows, all of them if not given: rows that are read together should lie together.
    ``parts`` and ``buckets`` belong to the stored files and can't change afterwards.
    """

    spark: SparkSession
    path: str
    columns: str
    keys: list[str]
    by: list[str] | None = None
    parts: int = 64
    buckets: int = 16
    name: str = field(default_factory=lambda: f"keyed_{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY ({', '.join(self.keys)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        if exists(self.spark, self.path):
            self.spark.catalog.recoverPartitions(self.name)  # of files that an earlier session stored

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def touched(self, rows: DataFrame) -> list[int]:
        """The partitions that the rows fall in."""
        return sorted(r[0] for r in self._placed(rows).select("part").distinct().collect())

    def beside(self, parts: list[int]) -> DataFrame:
        """What is stored in those partitions."""
        return self.spark.table(self.name).where(F.col("part").isin(parts))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.parts)).cast("int"))

    def merged(self, rows: DataFrame, merge: dict[str, Column], parts: list[int]) -> DataFrame:
        """The partitions ``parts`` after the upsert of ``rows``, one a key: the stored side of the join stays where it is."""
        new = self._placed(rows).repartition(self.buckets, *self.keys)
        return upserted(self.beside(parts), new, self.keys, merge)

    def upsert(self, rows: DataFrame, merge: dict[str, Column] | None = None) -> list[int]:
        """Store the rows, one a key, and give the partitions rewritten.  ``merge`` is as in :func:`sigloom.operators.state.upserted`."""
        parts = self.touched(rows)
        if not parts:
            return parts
        conf, key = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        old = conf.get(key)
        conf.set(key, "dynamic")
        try:
            self.merged(rows, merge or {}, parts).write.mode("overwrite").insertInto(self.name)
        finally:
            conf.set(key, old)
        self.spark.catalog.refreshTable(self.name)
        return parts


ENTITY = ["entity_type", "entity_id"]


class Profiles:
    """Entity profiles that grow by increments of the minute features; what was added before isn't read again.

    First and last bin, counts, a count for each signature and the set of addresses are merged by key.  An increment holds bins that no
    other has, and has a name: rows remember the last one added to them, so that an increment which broke off can be added again.
    Increments are added one after the other.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 64, buckets: int = 16, time: str = "timestamp"):
        kept = {"parts": parts, "buckets": buckets}
        self.stats = KeyedTable(spark, f"{root}/stats", f"entity_type string, entity_id string, first_seen {time}, last_seen {time}, event_count bigint, run string", ENTITY, **kept)
        self.signatures = KeyedTable(spark, f"{root}/signatures", "entity_type string, entity_id string, secondary_id string, value double, run string", [*ENTITY, "secondary_id"], ENTITY, **kept)
        self.addresses = KeyedTable(spark, f"{root}/addresses", "entity_type string, entity_id string, secondary_id string, run string", [*ENTITY, "secondary_id"], ENTITY, **kept)

    def add(self, features: DataFrame, run: str) -> dict[str, list[int]]:
        """Merge the features of new bins; gives the partitions rewritten of each table."""
        mark = F.lit(run).alias("run")
        again = F.col("old.run") == F.col("new.run")
        plus = lambda c: F.when(F.coalesce(again, F.lit(False)), F.col(f"old.{c}")).otherwise(F.coalesce(f"old.{c}", F.lit(0)) + F.coalesce(f"new.{c}", F.lit(0)))
        latest = F.coalesce("new.run", "old.run")
        stats = X.entity_stats(features).select("*", mark)
        counted = features.where("feature_name = 'signature_count'").groupBy(*ENTITY, "secondary_id").agg(F.sum("value").alias("value")).select("*", mark)
        seen = features.where("feature_name = 'src_ip_count'").select(*ENTITY, "secondary_id").distinct().select("*", mark)
        return {
            "stats": self.stats.upsert(stats, {"first_seen": F.least("old.first_seen", "new.first_seen"), "last_seen": F.greatest("old.last_seen", "new.last_seen"), "event_count": plus("event_count"), "run": latest}),
            "signatures": self.signatures.upsert(counted, {"value": plus("value"), "run": latest}),
            "addresses": self.addresses.upsert(seen),
        }

    def profiles(self, compat: Compat = DEFAULT) -> DataFrame:
        """The same as :func:`sigloom.operators.features.profiles` over all that was added."""
        named = lambda t, name: t.rows().withColumn("feature_name", F.lit(name))
        ips = X.unique_src_ips(named(self.addresses, "src_ip_count"))
        top = X.top_signatures(named(self.signatures, "signature_count"), compat)
        return self.stats.rows().drop("run").join(ips, ENTITY, "left").join(top, ENTITY, "left")
