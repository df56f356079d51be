"""Detection and correlation as streams: what :func:`sigloom.plans.batch.swept_signals` finds in stored tables, as events come.

Events are counted by minute and entity first, natively and merged with what comes late, and a minute goes on once the watermark has
passed it.  So the stateful operators see each bin of an entity once and in order, a row a minute and not a row an event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sigloom.operators import detect, features
from sigloom.operators.correlate import CAP_HOURS, GAP_MINUTES

MINUTE = 60_000_000
ROW = "feature_name string, entity_type string, entity_id string, at timestamp, current double, baseline double, ready timestamp"
SIGNAL = "window_start timestamp, window_end timestamp, signal_name string, severity int, score double, dedupe_key string, metadata string"


def _plain(out: pd.DataFrame, *texts: str) -> pd.DataFrame:
    """Text columns as plain objects: the worker takes no column in chunks."""
    return out.astype({c: object for c in texts})


def minute_bins(events: DataFrame) -> DataFrame:
    """(feature_name, entity_type, entity_id, bin, value, ready) of a watermarked stream of normalized events, each bin once."""
    wanted = [f for f in features.minute_features() if f.name == "auth_fail_count" and f.entity_type == "host"] + features.baseline_features()
    tags = features.tags(wanted)
    flat = events.select("event_time", F.explode(tags).alias("f"))
    keys = ["f.feature_name", "f.entity_type", "f.entity_id"]
    counted = flat.groupBy(F.window("event_time", "60 seconds").alias("w"), *keys).agg(F.coalesce(F.avg("f.mean"), F.count("*").cast("double")).alias("value"))
    return counted.select("feature_name", "entity_type", "entity_id", F.unix_micros("w.start").alias("bin"), "value", F.window_time("w").alias("ready"))


class Windows(StatefulProcessor):
    """The windows of each bin of a feature and entity: the current one's sum or mean, and the baseline's mean.

    A map from bin to value goes back as far as the baseline; of all events only the last bin is kept, and a timer tells
    when the entity has been quiet for long enough.  A timer also empties the map, so that an entity that isn't seen again leaves no state.
    """

    def __init__(self, windows: detect.Baselines):
        span = lambda t: int(t.total_seconds()) * 1_000_000
        self.current, self.whole, self.quiet = span(windows.current), span(windows.current + windows.baseline), span(windows.quiet)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getMapState("bins", "bin long", "value double")
        self.last = handle.getValueState("last", "bin long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values("bin")
        made = list(zip(pdf["bin"].tolist(), pdf["value"].tolist(), strict=True))
        out = list(self._seen([b for b, _ in made]) if key[0] == "event_count" else self._counted(key, made))
        yield self._rows(key, out)

    def _seen(self, bins: list[int]) -> Iterator[tuple]:
        last = self.last.get()[0] if self.last.exists() else None
        for b in bins:
            if last is not None and b > last + self.quiet:
                yield last + self.quiet, 0.0, 0.0
            last = max(last or b, b)
        self.last.update((last,))
        self._wake(last + self.quiet + MINUTE)

    def _counted(self, key, made: list[tuple[int, float]]) -> Iterator[tuple]:
        known = {k[0]: v[0] for k, v in self.bins.iterator()}
        for b, value in made:
            known[b] = value
            self.bins.updateValue((b,), (value,))
            now = [v for k, v in known.items() if b - self.current < k <= b]
            base = [v for k, v in known.items() if b - self.whole < k <= b - self.current]
            total = sum(now) / len(now) if key[0] == "error_rate" else sum(now)
            yield b, total, sum(base) / len(base) if base else 0.0
        self._forget(known, made[-1][0])
        self._wake(made[-1][0] + self.whole + MINUTE)

    def _forget(self, known, upto: int) -> None:
        for k in known:
            if k <= upto - self.whole:
                self.bins.removeKey((k,))

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        if self.last.exists():
            found.append((self.last.get()[0] + self.quiet, 0.0, 0.0))
            self.last.clear()
        self.bins.clear()
        yield self._rows(key, found)

    @staticmethod
    def _rows(key, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["at", "current", "baseline"])
        at = pd.to_datetime(out["at"], unit="us", utc=True).dt.tz_localize(None)
        out = out.assign(feature_name=key[0], entity_type=key[1], entity_id=key[2], at=at, ready=at + pd.Timedelta(seconds=60))
        return _plain(out[["feature_name", "entity_type", "entity_id", "at", "current", "baseline", "ready"]], "feature_name", "entity_type", "entity_id")

    def close(self) -> None:
        pass


def baseline_stream(events: DataFrame, windows: detect.Baselines = detect.Baselines()) -> DataFrame:
    """Signals of the three baseline detectors, with ``ready``: the time at which the stream can know of one."""
    bins = minute_bins(events).groupBy("feature_name", "entity_type", "entity_id")
    rows = bins.transformWithStateInPandas(Windows(windows), outputStructType=ROW, outputMode="append", timeMode="EventTime", eventTimeColumnName="ready")
    return detect.judged(rows, windows, "ready")


def signal_stream(events: DataFrame, windows: detect.Baselines = detect.Baselines(), hours: int = 1) -> DataFrame:
    """Signals of all five detectors: bad events by windows of so many hours, alerts one by one."""
    alerts = detect.promoted_alerts(events).withColumn("ready", F.col("window_end"))
    wanted = [f for f in features.minute_features() if f.name == "bad_event_count"]
    flat = events.select("event_time", features.bin_start(F.col("event_time"), 60).alias("bin"), F.explode(features.tags(wanted)).alias("f"))
    bad = flat.groupBy(F.window("event_time", f"{hours} hours").alias("w"), "f.entity_type", "f.entity_id").agg(F.count("*").cast("double").alias("score"), F.min("bin").alias("window_start"), F.max("bin").alias("window_end"))
    spikes = detect.over_threshold(bad, F.col("window_end"), more=[F.window_time("w").alias("ready")])
    return baseline_stream(events, windows).unionByName(spikes).unionByName(alerts)


class Correlator(StatefulProcessor):
    """Incidents of an entity that may still take signals, as (start, last, incident id) rows, and signals that wait for their turn.

    A signal's turn comes once the watermark is ``lag`` past its end: then all that end earlier are there, so the fold
    goes by ends as over a stored table.  Of signals of one key the first in the batch job's order counts.  When no incident can take a
    signal any more the state is empty.
    """

    def __init__(self, lag: int):
        self.lag = lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, incident string")
        self.waiting = handle.getMapState("waiting", "key string", "start long, last long, name string, severity int, score double, metadata string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in zip(pdf["dedupe_key"], pdf["start_us"].tolist(), pdf["end_us"].tolist(), pdf["signal_name"], pdf["severity"].tolist(), pdf["score"].tolist(), pdf["metadata"], strict=True):
                own, held = r[1:], self.waiting.getValue((r[0],)) if self.waiting.containsKey((r[0],)) else None
                if held is None or (own[0], own[4], own[5] or "") < (held[0], held[4], held[5] or ""):
                    self.waiting.updateValue((r[0],), own)
                self.handle.registerTimer(-(-(own[1] + self.lag) // 1000))
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 - self.lag
        gap, cap = GAP_MINUTES * 60_000_000, CAP_HOURS * 3_600_000_000
        known = [list(x) for x in self.open.get()]
        due = sorted((v[1], k[0], v) for k, v in self.waiting.iterator() if v[1] <= now)
        out = []
        for e, signal, v in due:
            able = [x for x in known if x[1] >= e - gap and x[0] >= e - cap]
            if able:
                to = max(able, key=lambda x: (x[1], x[2]))
                to[1] = max(to[1], e)
            else:
                to = [v[0], e, signal]
                known.append(to)
            out.append((v[0], e, v[2], v[3], v[4], signal, v[5], to[2], not able))
            self.waiting.removeKey((signal,))
        kept = [(int(a), int(b), c) for a, b, c in known if b >= now - gap]
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(-(-(max(b for _, b, _ in kept) + gap + self.lag) // 1000) + 1)
        else:
            self.open.clear()
        yield self._rows(key, out)

    @staticmethod
    def _rows(key, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["window_start", "window_end", "signal_name", "severity", "score", "dedupe_key", "metadata", "incident_id", "founder"])
        times = {c: pd.to_datetime(out[c], unit="us", utc=True).dt.tz_localize(None) for c in ("window_start", "window_end")}
        out = out.assign(entity_type=key[0], entity_id=key[1], **times)[["entity_type", "entity_id", "window_start", "window_end", "signal_name", "severity", "score", "dedupe_key", "metadata", "incident_id", "founder"]]
        return _plain(out, "entity_type", "entity_id", "signal_name", "dedupe_key", "metadata", "incident_id")

    def close(self) -> None:
        pass


def correlated_stream(signals: DataFrame, lag_minutes: int = 0) -> DataFrame:
    """Signals with incident_id and founder, of a watermarked stream of signals; needs the RocksDB state store (``ROCKS``).

    ``lag_minutes``: how long after its end a signal may come, by the watermark; windows of an hour need 60.
    """
    micros = {"start_us": F.unix_micros(F.col("window_start").cast("timestamp")), "end_us": F.unix_micros(F.col("window_end").cast("timestamp"))}
    out = "entity_type string, entity_id string, " + SIGNAL + ", incident_id string, founder boolean"
    return signals.withColumns(micros).groupBy("entity_type", "entity_id").transformWithStateInPandas(Correlator(lag_minutes * MINUTE), outputStructType=out, outputMode="append", timeMode="EventTime")


class TopN(StatefulProcessor):
    """The most frequent values of a key, exact: a count for each value, and the ranks that a batch changed.

    Once the watermark is past the key's ``until`` its counts are dropped.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "value string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        before = self._best(counts)
        if not counts:
            self.handle.registerTimer(-(-key[0] // 1000))
        for pdf in rows:
            for value, n in pdf.groupby("value")["n"].sum().items():
                counts[value] = counts.get(value, 0) + int(n)
                self.counts.updateValue((value,), (counts[value],))
        now = self._best(counts)
        new = [(i + 1, *x) for i, x in enumerate(now) if i >= len(before) or before[i] != x]
        yield self._rows(key, new)

    @staticmethod
    def _rows(key, new: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(new, columns=["rank", "value", "count"]).assign(until=key[0], entity_id=key[1])
        return _plain(out[["until", "entity_id", "rank", "value", "count"]], "entity_id", "value")

    def _best(self, counts: dict[str, int]) -> list[tuple[str, int]]:
        return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[: self.n]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        yield self._rows(key, [])

    def close(self) -> None:
        pass


def top_src_ip_stream(events: DataFrame, seconds: int = 300, n: int = 5) -> DataFrame:
    """(bin_start, host, rank, src_ip, count) of a watermarked stream, in update mode: a row takes the place of the earlier one of its bin, host and rank.

    As counts only grow, no rank is ever vacated; an address that falls back shows up again in its new rank.
    """
    start = F.unix_micros(features.bin_start(F.col("event_time"), seconds).cast("timestamp"))
    host = features.named("host")
    rows = events.where("src_ip IS NOT NULL").select("event_time", (start + seconds * 1_000_000).alias("until"), host.alias("entity_id"), F.col("src_ip").alias("value"), F.lit(1).cast("long").alias("n"))
    best = rows.groupBy("until", "entity_id").transformWithStateInPandas(TopN(n), outputStructType="until long, entity_id string, rank int, value string, count long", outputMode="update", timeMode="EventTime")
    return best.select(F.timestamp_micros(F.col("until") - seconds * 1_000_000).alias("bin_start"), F.col("entity_id").alias("host"), "rank", F.col("value").alias("src_ip"), "count")
