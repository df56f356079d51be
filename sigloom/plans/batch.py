"""The whole job in batch: raw events to incidents.

What several stages read is stored once, in the work folder: normalized events, features and signals with their
incidents.  What later runs read again is stored by date: :func:`store`.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigloom.operators import correlate, detect, features, normalize, state
from sigloom.params import DEFAULT, Compat
from sigloom.storage import exists, stored


@dataclass
class Result:
    normalized: DataFrame
    rejected: DataFrame
    features: DataFrame
    signals: DataFrame
    assigned: DataFrame
    incidents: DataFrame
    evidence: DataFrame


def signals_of(table: DataFrame, events: DataFrame, start: Column | None = None, end: Column | None = None, as_of: Column | None = None, now: datetime | None = None, windows: detect.Baselines = detect.Baselines()) -> DataFrame:
    """Signals of all five detectors: baselines at ``now``, the latest bin if not given, thresholds and alerts of [start, end)."""
    clock = now or detect.feature_clock(table)
    return detect.run_detections(table, events, start, end, as_of, detect.run_baselines(table, clock, windows))


def swept_signals(table: DataFrame, events: DataFrame, now: datetime | None = None, windows: detect.Baselines = detect.Baselines(), hours: int = 1) -> DataFrame:
    """Signals as runs at every minute find them: baselines at each bin, bad events by windows of hours, and alerts; see :mod:`sigloom.streaming.detect`."""
    clock = now or detect.feature_clock(table)
    spikes = detect.bad_event_spikes(table, by=[F.window("bin_start", f"{hours} hours")])
    both = detect.judged(detect.swept(table, clock, windows), windows).unionByName(spikes).unionByName(detect.promoted_alerts(events))
    return state.first_per_key(both, ["dedupe_key"], ["window_start", "score", "metadata"])


def feature_table(events: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """The minute features that detectors and profiles read."""
    return features.minute_rollup(events, features=[*features.minute_features(), *features.baseline_features()], compat=compat)


def run(raw: DataFrame, start: Column | None = None, end: Column | None = None, as_of: Column | None = None, compat: Compat = DEFAULT, now: datetime | None = None, windows: detect.Baselines = detect.Baselines()) -> Result:
    """All stages over raw events, with signals of [start, end) and of the baselines at ``now``."""
    keyed = state.first_per_key(raw, ["event_key"], ["id"]) if "event_key" in raw.columns else raw
    events = stored(normalize.normalize(keyed, compat), "normalized")
    table = stored(feature_table(events, compat), "features")
    assigned = stored(correlate.assign(signals_of(table, events, start, end, as_of, now, windows)), "signals")
    signals = assigned.drop("incident_id", "founder")
    return Result(events, normalize.rejected(keyed, compat), table, signals, assigned, correlate.incidents(assigned), correlate.evidence(assigned))


@dataclass
class Tables:
    """What correlation keeps between runs, below one folder of the shared store.

    A run is a name.  It first stores its signals with their incidents (``assigned``) and the incidents that they change, as they
    are afterwards (``changed``), then brings ``incidents`` up to date with those, and is done: a run that broke off goes on from what it
    has stored, and one that is done changes nothing when it is repeated.  ``incidents`` lies by the date of its start, so only the
    dates of incidents that a run changes are rewritten.
    """

    spark: SparkSession
    root: str

    def incidents(self, since: Column | None = None) -> DataFrame | None:
        """All incidents, or those that started on the day of ``since`` or later."""
        path = f"{self.root}/incidents"
        return load(self.spark, path, since) if exists(self.spark, path) else None

    def assigned(self) -> DataFrame | None:
        """The signals of all runs with incident_id, founder and run."""
        path = f"{self.root}/assigned"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def correlate(self, signals: DataFrame, run: str) -> DataFrame:
        """Attach signals to incidents; gives those that no earlier run had, with incident_id and founder."""
        own = {name: f"{self.root}/{name}/run={run}" for name in ("assigned", "changed", "done")}
        if not exists(self.spark, f"{own['changed']}/_SUCCESS"):
            seen = self.assigned()
            new = signals if seen is None else signals.join(seen.where(F.col("run") != run).select("dedupe_key"), "dedupe_key", "left_anti").select(*signals.columns)
            new = stored(new, "new")
            near = self._reachable(new)
            correlate.assign(new, table=near).write.mode("overwrite").parquet(own["assigned"])
            correlate.changed(near, self.spark.read.parquet(own["assigned"])).write.mode("overwrite").parquet(own["changed"])
        if not exists(self.spark, own["done"]):
            rows = self.spark.read.parquet(own["changed"])
            if not rows.isEmpty():
                store(self._merged(rows), f"{self.root}/incidents", "start_time")
            self.spark.range(0).write.mode("overwrite").parquet(own["done"])
        return self.spark.read.parquet(own["assigned"])

    def _reachable(self, new: DataFrame) -> DataFrame:
        """The incidents that the first of the signals, or a later one, can join; earlier dates aren't read."""
        first = new.agg(F.min("window_end")).first()[0]
        gap, cap = (F.expr(f"INTERVAL '{n}' {unit}") for n, unit in ((correlate.GAP_MINUTES, "MINUTE"), (correlate.CAP_HOURS, "HOUR")))
        table = self.incidents(F.lit(first) - cap) if first is not None else None
        if table is None:
            return correlate.empty_table(new)
        return table.where((F.col("last_update_time") >= F.lit(first) - gap) & (F.col("start_time") >= F.lit(first) - cap))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """All incidents of the dates that ``rows`` has."""
        if self.incidents() is None:
            return rows
        days = [r[0] for r in rows.select(F.to_date("start_time")).distinct().collect()]
        near = self.spark.read.parquet(f"{self.root}/incidents").where(F.col("date").isin(days)).drop("date")
        return stored(state.upserted(near, rows, ["incident_id"]).select(*rows.columns), "merged")


def store(rows: DataFrame, path: str, time: str) -> None:
    """Write a table by date, replacing the dates that ``rows`` has.

    Rows are rebalanced by date: small dates share a task, and a date of more than a partition's size is split.
    """
    dated = rows.withColumn("date", F.to_date(time))
    dated.hint("rebalance", "date").sortWithinPartitions(time).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("date").parquet(path)


def load(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Read such a table; a range of dates prunes its folders."""
    rows = spark.read.parquet(path)
    rows = rows if start is None else rows.where(F.col("date") >= F.to_date(start))
    rows = rows if end is None else rows.where(F.col("date") <= F.to_date(end))
    return rows.drop("date")
