"""Signals: threshold and baseline anomalies of the feature table, and promoted alerts.

Every detector takes its window and clock as arguments and gives rows of ``COLUMNS``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from sigloom.functions.columns import filled, signal_key, spike_key
from sigloom.operators.features import BASELINE

BAD_EVENTS = 50  # fixed value
COLUMNS = ["event_time", "window_start", "window_end", "signal_name", "entity_type", "entity_id", "severity", "score", "dedupe_key", "metadata"]


@dataclass(frozen=True)
class Baselines:
    """The windows and bounds of the baseline detectors."""

    current: timedelta = timedelta(hours=1)
    baseline: timedelta = timedelta(hours=6)
    quiet: timedelta = timedelta(hours=1)
    lookback: timedelta = timedelta(hours=24)
    least: float = 5
    rate: float = 0.05
    factor: float = 2


def feature_clock(features: DataFrame, bin_size_sec: int = 60) -> datetime | None:
    """The latest bin: the data's own clock, None without any; detectors without a clock give no signal."""
    row: Row = features.where(F.col("bin_size_sec") == bin_size_sec).agg(F.max("bin_start")).first()
    return row[0]


def _at(now: datetime | None, before: timedelta = timedelta()) -> Column:
    """A time as the clock's kind of timestamp: null without a clock."""
    return F.lit(None).cast("timestamp") if now is None else F.lit(now - before)


def _windows(now: datetime | None, current: timedelta, baseline: timedelta) -> tuple[Column, Column]:
    start, past = _at(now, current), _at(now, current + baseline)
    bin_ = F.col("bin_start")
    return bin_ > start, (bin_ > past) & (bin_ <= start)


def _signal(rows: DataFrame, now: datetime | None, window: timedelta, name: str, kind: str, severity: int, metadata: Column) -> DataFrame:
    at = _at(now)
    return rows.select(at.alias("event_time"), _at(now, window).alias("window_start"), at.alias("window_end"), F.lit(name).alias("signal_name"), F.lit(kind).alias("entity_type"), "entity_id", F.lit(severity).alias("severity"), "score", spike_key(name, kind, F.col("entity_id"), at).alias("dedupe_key"), metadata.alias("metadata"))


def auth_fail_spikes(features: DataFrame, now: datetime | None, current: timedelta = timedelta(hours=1), baseline: timedelta = timedelta(hours=6), bin_size_sec: int = 60, least: float = 5) -> DataFrame:
    """Hosts whose failures in the current window are at least 5 and over 3 times the mean baseline bin plus 5.

    The mean is over bins that exist.  One aggregate serves both windows.
    """
    in_now, in_base = _windows(now, current, baseline)
    rows = features.where((F.col("feature_name") == "auth_fail_count") & (F.col("entity_type") == "host") & (F.col("bin_size_sec") == bin_size_sec) & (in_now | in_base))
    agg = rows.groupBy("entity_id").agg(F.sum(F.when(in_now, F.col("value"))).alias("current_sum"), F.coalesce(F.avg(F.when(in_base, F.col("value"))), F.lit(0.0)).alias("baseline_avg"))
    hit = agg.where((F.col("current_sum") >= least) & (F.col("current_sum") > F.col("baseline_avg") * 3 + 5)).withColumn("score", F.col("current_sum") / (F.col("baseline_avg") + 0.1))
    return _signal(hit, now, current, "auth_fail_spike", "host", 7, F.to_json(F.struct("current_sum", "baseline_avg")))


def silent_agents(features: DataFrame, now: datetime | None, quiet: timedelta = timedelta(hours=1), lookback: timedelta = timedelta(hours=24), bin_size_sec: int = 60, entity_type: str = "host", feature: str = "event_count") -> DataFrame:
    """Entities active in the lookback but not in its last, quiet, part."""
    bin_ = F.col("bin_start")
    rows = features.where((F.col("feature_name") == feature) & (F.col("entity_type") == entity_type) & (F.col("bin_size_sec") == bin_size_sec) & (bin_ > _at(now, lookback)))
    last = rows.groupBy("entity_id").agg(F.max("bin_start").alias("last")).where((F.col("last") <= _at(now, quiet)) & (F.col("entity_id") != "(none)"))
    return _signal(last.withColumn("score", F.lit(10.0)), now, quiet, "agent_silent", entity_type, 3, F.lit("{}"))


def app_error_spikes(features: DataFrame, now: datetime | None, current: timedelta = timedelta(hours=1), baseline: timedelta = timedelta(hours=6), bin_size_sec: int = 60, rate: float = 0.05, factor: float = 2) -> DataFrame:
    """Endpoints whose mean error rate is over 5 % and over twice that of the baseline."""
    in_now, in_base = _windows(now, current, baseline)
    rows = features.where((F.col("feature_name") == "error_rate") & (F.col("entity_type") == "endpoint") & (F.col("bin_size_sec") == bin_size_sec) & (in_now | in_base))
    agg = rows.groupBy("entity_id").agg(F.avg(F.when(in_now, F.col("value"))).alias("current_rate"), F.coalesce(F.avg(F.when(in_base, F.col("value"))), F.lit(0.0)).alias("baseline_rate"))
    hit = agg.where((F.col("current_rate") > rate) & (F.col("current_rate") > F.col("baseline_rate") * factor)).withColumn("score", F.col("current_rate") / (F.col("baseline_rate") + 0.01))
    named = hit.withColumn("entity_id", F.when(F.coalesce("entity_id", F.lit("")).isin("", "(none)"), "juiceshop_global").otherwise(F.col("entity_id")))
    return _signal(named, now, current, "app_error_spike", "application", 5, F.to_json(F.struct("current_rate", "baseline_rate")))


def run_baselines(features: DataFrame, now: datetime | None, windows: Baselines = Baselines(), bin_size_sec: int = 60) -> DataFrame:
    """The three baseline detectors at one clock."""
    w = windows
    auth = auth_fail_spikes(features, now, w.current, w.baseline, bin_size_sec, w.least)
    silent = silent_agents(features, now, w.quiet, w.lookback, bin_size_sec)
    errors = app_error_spikes(features, now, w.current, w.baseline, bin_size_sec, w.rate, w.factor)
    return auth.unionByName(silent).unionByName(errors)


# The same detectors at every bin, not at one clock: what a run each minute finds.


def swept(features: DataFrame, now: datetime | None, windows: Baselines = Baselines(), bin_size_sec: int = 60) -> DataFrame:
    """(feature_name, entity_type, entity_id, at, current, baseline): the windows of each bin that an entity has, and each time at which
    an entity has been quiet for long enough, up to ``now``.

    Sums only fall between the bins of an entity, so it is judged where it has one.
    """
    at = F.unix_seconds(F.col("bin_start").cast("timestamp"))
    rows = features.where((F.col("bin_size_sec") == bin_size_sec) & F.col("feature_name").isin("auth_fail_count", *BASELINE)).withColumn("__at", at)
    entity = Window.partitionBy("feature_name", "entity_type", "entity_id").orderBy("__at")
    seconds = lambda t: int(t.total_seconds())
    cur = entity.rangeBetween(1 - seconds(windows.current), 0)
    base = entity.rangeBetween(1 - seconds(windows.current + windows.baseline), -seconds(windows.current))
    value = F.col("value")
    spikes = rows.where("feature_name = 'auth_fail_count' AND entity_type = 'host' OR feature_name = 'error_rate' AND entity_type = 'endpoint'")
    total = F.when(F.col("feature_name") == "error_rate", F.avg(value).over(cur)).otherwise(F.sum(value).over(cur))
    spikes = spikes.select("feature_name", "entity_type", "entity_id", F.col("bin_start").cast("timestamp").alias("at"), total.alias("current"), F.coalesce(F.avg(value).over(base), F.lit(0.0)).alias("baseline"))
    alive = rows.where("feature_name = 'event_count' AND entity_type = 'host'").withColumn("__next", F.lead("__at").over(entity))
    until = F.col("__at") + seconds(windows.quiet)
    silent = alive.where(F.coalesce(F.col("__next") > until, until <= F.unix_seconds(_at(now).cast("timestamp"))))
    return spikes.unionByName(silent.select("feature_name", "entity_type", "entity_id", F.timestamp_seconds(until).alias("at"), F.lit(0.0).alias("current"), F.lit(0.0).alias("baseline")))


def judged(rows: DataFrame, windows: Baselines = Baselines(), *more: str) -> DataFrame:
    """Signals of such rows, with the columns ``more`` of theirs."""
    c, b, is_auth, is_error = F.col("current"), F.col("baseline"), F.col("feature_name") == "auth_fail_count", F.col("feature_name") == "error_rate"
    hit = F.when(is_auth, (c >= windows.least) & (c > b * 3 + 5)).when(is_error, (c > windows.rate) & (c > b * windows.factor)).otherwise(F.col("entity_id") != "(none)")
    entity = F.when(is_error & F.coalesce("entity_id", F.lit("")).isin("", "(none)"), "juiceshop_global").otherwise(F.col("entity_id"))
    name = F.when(is_auth, "auth_fail_spike").when(is_error, "app_error_spike").otherwise("agent_silent")
    kind = F.when(is_error, "application").otherwise(F.col("entity_type"))
    micros = lambda t: int(t.total_seconds()) * 1_000_000
    span = F.when(is_auth | is_error, micros(windows.current)).otherwise(micros(windows.quiet))
    meta = F.when(is_auth, F.to_json(F.struct(c.alias("current_sum"), b.alias("baseline_avg")))).when(is_error, F.to_json(F.struct(c.alias("current_rate"), b.alias("baseline_rate")))).otherwise("{}")
    made = {
        "event_time": F.col("at"),
        "window_start": F.timestamp_micros(F.unix_micros("at") - span),
        "window_end": F.col("at"),
        "signal_name": name,
        "entity_type": kind,
        "entity_id": entity,
        "severity": F.when(is_auth, 7).when(is_error, 5).otherwise(3),
        "score": F.when(is_auth, c / (b + 0.1)).when(is_error, c / (b + 0.01)).otherwise(10.0),
        "dedupe_key": F.concat_ws("|", name, kind, entity, F.date_format("at", "yyyyMMddHHmmss")),
        "metadata": meta,
    }
    return rows.where(hit).select(*[x.alias(n) for n, x in made.items()], *more)


def _keyed(rows: DataFrame, as_of: Column) -> DataFrame:
    key = signal_key(F.col("signal_name"), F.col("entity_type"), F.col("entity_id"), F.col("window_end"))
    return rows.withColumn("event_time", as_of).withColumn("dedupe_key", key).select(*COLUMNS)


def bad_event_spikes(features: DataFrame, start: Column | None = None, end: Column | None = None, as_of: Column | None = None, threshold: float = BAD_EVENTS, by: list[Column] | None = None) -> DataFrame:
    """Entities with more bad events in [start, end) than the threshold; all bin sizes add up.

    ``by`` splits the range, by day for instance.  The window runs from the first to the last bin start.
    """
    rows = features.where("feature_name = 'bad_event_count'")
    rows = rows if start is None else rows.where(F.col("bin_start") >= start)
    rows = rows if end is None else rows.where(F.col("bin_start") < end)
    agg = rows.groupBy("entity_type", "entity_id", *(by or [])).agg(F.sum("value").alias("score"), F.min("bin_start").alias("window_start"), F.max("bin_start").alias("window_end"))
    return over_threshold(agg, F.col("window_end") if as_of is None else as_of, threshold)


def over_threshold(sums: DataFrame, as_of: Column, threshold: float = BAD_EVENTS, more: list[Column] = []) -> DataFrame:
    """Signals of the sums (entity_type, entity_id, score, window_start, window_end) above the threshold, with ``more`` columns."""
    meta = F.to_json(F.struct(F.lit("bad_event_count").alias("feature"), F.lit(int(threshold)).alias("threshold"), F.col("score").cast("bigint").alias("value")))
    rows = sums.where(F.col("score") > threshold).select("window_start", "window_end", F.lit("Spike in Bad Events").alias("signal_name"), "entity_type", "entity_id", F.lit(7).alias("severity"), "score", meta.alias("metadata"), *more)
    keyed = rows.withColumn("event_time", as_of).withColumn("dedupe_key", signal_key(F.col("signal_name"), F.col("entity_type"), F.col("entity_id"), F.col("window_end")))
    return keyed.select(*COLUMNS, *[c for c in rows.columns if c not in COLUMNS])


def promoted_alerts(events: DataFrame, start: Column | None = None, end: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """Events of severity 7 and up and firewall intrusion events, each a signal at its own time."""
    rows = events.where("severity >= 7 OR (vendor = 'opnsense' AND event_kind = 'ids')")
    rows = rows if start is None else rows.where(F.col("event_time") >= start)
    rows = rows if end is None else rows.where(F.col("event_time") < end)
    by_ip = (F.col("vendor") == "opnsense") & filled(F.col("src_ip")).isNotNull()
    by_ip = F.coalesce(by_ip, F.lit(False))
    meta = F.to_json(F.struct("rule_id", "vendor", "src_ip", "dest_ip"))
    out = rows.select(
        F.col("event_time").alias("window_start"),
        F.col("event_time").alias("window_end"),
        F.coalesce(filled(F.col("signature")), F.concat("vendor", F.lit(" Alert"))).alias("signal_name"),
        F.when(by_ip, "ip").otherwise("host").alias("entity_type"),
        F.when(by_ip, F.col("src_ip")).otherwise(F.col("host")).alias("entity_id"),
        F.when(F.col("severity") > 0, F.col("severity")).otherwise(4).alias("severity"),
        F.lit(10.0).alias("score"),
        meta.alias("metadata"),
    ).where(F.coalesce("entity_id", F.lit("")) != "").where("entity_id <> 'unknown'")
    return _keyed(out, F.col("window_end") if as_of is None else as_of)


def window_of(checkpoint: datetime | None, now: datetime, lookback_minutes: int = 60) -> tuple[datetime, datetime]:
    """[checkpoint, now) with now floored to the minute; without a checkpoint the lookback."""
    end = now.replace(second=0, microsecond=0)
    return (checkpoint or end - timedelta(minutes=lookback_minutes)), end


def advanced(checkpoint: datetime | None, end: datetime) -> datetime:
    """A checkpoint never goes back."""
    return end if checkpoint is None else max(checkpoint, end)


def run_detections(features: DataFrame, events: DataFrame, start: Column | None, end: Column | None, as_of: Column | None = None, *more: DataFrame) -> DataFrame:
    """Both detectors over [start, end) and ``more`` signals, one for each key."""
    from sigloom.operators.state import first_per_key

    both = bad_event_spikes(features, start, end, as_of).unionByName(promoted_alerts(events, start, end, as_of))
    for signals in more:
        both = both.unionByName(signals)
    return first_per_key(both, ["dedupe_key"], ["window_start", "score", "metadata"])
