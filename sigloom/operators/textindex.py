"""Finding words in raw texts by an inverted index: which parts of the store hold a token, so that only those are read.

Events are stored by date and by block, a hash of their id; the index has a row for each token and part.  A search looks for its
words in the tokens, which are few against the texts, and reads the parts that hold one.  As a word may be any piece of a text, a part
counts if each of the word's runs of letters and digits lies in one of its tokens; the texts decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_TOKEN = r"[^\p{L}\p{N}_]+"
_RUN = re.compile(r"\w+")


@dataclass
class TextIndex:
    """Events and their index below ``root``; ``blocks`` is the number of parts that a date is cut into."""

    spark: SparkSession
    root: str
    id_col: str = "raw_id"
    time_col: str = "event_time"
    text_col: str = "raw"
    blocks: int = 16

    def add(self, events: DataFrame) -> None:
        """Store events of dates that aren't stored yet, or whole dates anew; nulls in time have a date of their own."""
        block = F.pmod(F.xxhash64(self.id_col), F.lit(self.blocks)).cast("int")
        rows = events.withColumns({"date": F.coalesce(F.to_date(self.time_col).cast("string"), F.lit("none")), "block": block})
        out = rows.hint("rebalance", "date", "block").sortWithinPartitions("date", "block").write.option("partitionOverwriteMode", "dynamic")
        out.mode("overwrite").partitionBy("date", "block").parquet(f"{self.root}/events")
        dates = [r[0] for r in rows.select("date").distinct().collect()]
        stored = self.spark.read.parquet(f"{self.root}/events").where(F.col("date").isin(dates))
        tokens = stored.select("date", "block", F.explode(F.array_distinct(F.split(F.lower(self.text_col), _TOKEN))).alias("token")).where("token <> ''").distinct()
        tokens.repartition("date").sortWithinPartitions("token").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("date").parquet(f"{self.root}/tokens")

    def parts(self, words: list[str], start: Column | None = None, end: Column | None = None) -> DataFrame | None:
        """(date, block) of the parts that may hold a word, in [start, end] by date; None if a word has nothing to look up."""
        runs = [sorted(set(_RUN.findall(w.lower()))) for w in words]
        if not all(runs):
            return None
        has = {r: F.col("token").contains(r) for own in runs for r in own}
        tokens = self._between(self.spark.read.parquet(f"{self.root}/tokens"), start, end).where(reduce(or_, has.values()))
        held = tokens.groupBy(F.col("date").cast("string").alias("date"), "block").agg(*[F.bool_or(c).alias(f"r{i}") for i, c in enumerate(has.values())])
        column = {r: F.col(f"r{i}") for i, r in enumerate(has)}
        return held.where(reduce(or_, (reduce(and_, (column[r] for r in own)) for own in runs))).select("date", "block")

    def _between(self, rows: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
        rows = rows if start is None else rows.where(F.col("date") >= F.to_date(start).cast("string"))
        return rows if end is None else rows.where(F.col("date") <= F.to_date(end).cast("string"))

    def find(self, words: list[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
        """The events that hold one of the words; their parts are joined before anything else of them is read."""
        rows = self._between(self.spark.read.schema(self._schema()).parquet(f"{self.root}/events"), start, end)
        parts = self.parts(words, start, end)
        # A row a part, at most so many as there are folders: the join prunes folders when the query runs.
        near = rows if parts is None else rows.join(F.broadcast(parts), ["date", "block"], "left_semi")
        hit = F.lit(False)
        for w in words:
            hit = hit | F.col(self.text_col).contains(w)
        return near.where(hit).drop("date", "block")

    def _schema(self):
        """A date is read as text, as it is stored."""
        found = self.spark.read.parquet(f"{self.root}/events").drop("date", "block").schema
        return found.add("date", "string").add("block", "integer")
