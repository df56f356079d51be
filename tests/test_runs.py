"""The job's baselines, and correlation over several runs against lookups in one table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sigloom.operators import correlate, detect, features
from sigloom.plans import batch
from sigloom.sources.adapter import normalized_events
from sigloom.storage import work_path

from .test_engine import SIGNALS, T, signal


def lookups(runs, shut=()):
    """{signal: incident} and the incidents, a lookup in the table for each signal; ``shut`` closes incidents after run 0."""
    table, out = {}, {}
    for i, rows in enumerate(runs):
        for _, start, end, name, kind, entity, severity, score, key, _ in sorted(rows, key=lambda r: (r[2], r[8])):
            able = [x for x in table.values() if x["e"] == (kind, entity) and x["open"] and x["last"] >= end - timedelta(minutes=30) and x["start"] >= end - timedelta(hours=4)]
            if able:
                x = max(able, key=lambda x: (x["last"], x["start"], x["id"]))
                x.update(last=max(x["last"], end), severity=max(x["severity"], severity), score=x["score"] + min(score, 50))
            else:
                x = table[key] = {"e": (kind, entity), "start": start, "last": end, "id": key, "open": True, "severity": severity, "score": score, "title": f"{name} on {entity}"}
            out[key] = x["id"]
        for x in table.values():
            x["open"] = x["open"] and not (i == 0 and x["e"][1] in shut)
    return out, table


def run_all(spark, runs, shut=()):
    tables = batch.Tables(spark, work_path(spark, "runs"))
    for i, rows in enumerate(runs):
        tables.correlate(spark.createDataFrame(rows, SIGNALS).repartition(3), f"r{i}")
        if not i and shut and tables.incidents() is not None:
            path = work_path(spark, "shut")
            tables.incidents().withColumn("status", F.when(F.col("root_entity_id").isin(*shut), "CLOSED").otherwise("ACTIVE")).write.parquet(path)
            batch.store(spark.read.parquet(path), f"{tables.root}/incidents", "start_time")
    return tables


def check(tables, runs, shut=()):
    want, table = lookups(runs, shut)
    assert {r.dedupe_key: r.incident_id for r in tables.assigned().collect()} == want
    got = {r.incident_id: r for r in tables.incidents().collect()}
    assert set(got) == set(table)
    for key, x in table.items():
        r = got[key]
        assert (r.title, r.severity, r.start_time, r.last_update_time, r.end_time) == (x["title"], x["severity"], x["start"], x["last"], x["last"])
        assert abs(r.score - x["score"]) < 1e-6 and (r.root_entity_type, r.root_entity_id) == x["e"]


def test_thirds_equal_the_whole(spark):
    rng = random.Random(4)
    rows = [signal(f"k{i:04}", rng.randrange(0, 3000), f"h{rng.randrange(6)}", rng.choice([0, 0, 9, 300]), score=rng.choice([5.0, 80.0]), severity=rng.randrange(8)) for i in range(600)]
    rows.sort(key=lambda r: (r[2], r[8]))
    runs = [rows[:200], rows[200:400], rows[400:]]
    tables = run_all(spark, runs)
    check(tables, runs)
    assert {r.dedupe_key: r.incident_id for r in tables.assigned().collect()} == lookups([rows])[0]
    whole = correlate.incidents(correlate.assign(spark.createDataFrame(rows, SIGNALS)))
    assert tables.incidents().select(*whole.columns).drop("score").exceptAll(whole.drop("score")).count() == 0


def test_late_signals_and_closed_incidents(spark):
    """Runs whose signals overlap in time: those that come late go to the incident last updated, as in the table."""
    rng = random.Random(12)
    rows = [signal(f"k{i:04}", rng.randrange(0, 2500), f"h{rng.randrange(7)}", rng.choice([0, 0, 20, 400])) for i in range(500)]
    runs = [[], [], [], []]
    for r in rows:
        runs[rng.randrange(4)].append(r)
    tables = run_all(spark, runs, ("h1", "h2"))
    check(tables, runs, ("h1", "h2"))
    kept = tables.incidents().where("status = 'CLOSED'")
    assert 0 < kept.count() and kept.where("root_entity_id NOT IN ('h1', 'h2')").count() == 0


def test_repeated_and_broken_runs(spark):
    rows = [signal(f"k{i}", 10 * i) for i in range(9)]
    tables = run_all(spark, [rows[:3], rows[3:6]])
    before = tables.incidents().collect()
    tables.correlate(spark.createDataFrame(rows[3:6], SIGNALS), "r1")  # the same run again
    tables.correlate(spark.createDataFrame(rows[:6], SIGNALS), "r2")  # known signals under another name
    assert tables.incidents().collect() == before
    one = tables.assigned().where("run = 'r1'").count()
    assert one == 3 and tables.assigned().count() == 6
    # A run that broke off after its first two steps goes on from them.
    store, batch.store = batch.store, None
    try:
        tables.correlate(spark.createDataFrame(rows[6:], SIGNALS), "r3")
    except TypeError:
        pass
    finally:
        batch.store = store
    assert tables.incidents().collect() == before
    tables.correlate(spark.createDataFrame(rows[6:], SIGNALS).limit(0), "r3")
    check(tables, [rows[:3], rows[3:6], rows[6:]])


def test_only_touched_dates_are_rewritten(spark):
    from pathlib import Path

    days = [[signal(f"a{d}{i}", 1440 * d + 5 * i, f"h{i % 2}") for i in range(6)] for d in range(3)]
    tables = run_all(spark, [[r for d in days for r in d]])
    files = lambda: {str(p) for p in Path(tables.root, "incidents").rglob("*.parquet")}
    before = files()
    tables.correlate(spark.createDataFrame([signal("late", 1440 * 2 + 40, "h0")], SIGNALS), "more")
    gone, new = before - files(), files() - before
    assert gone and all("date=2025-01-03" in p for p in gone | new)


def test_empty_tables_give_no_signals(spark, sf):
    events = normalized_events(spark, sf).limit(0)
    table = batch.feature_table(events)
    assert detect.feature_clock(table) is None
    assert batch.signals_of(table, events).collect() == []
    tables = batch.Tables(spark, work_path(spark, "runs"))
    assert tables.correlate(batch.signals_of(table, events), "a").collect() == [] and tables.incidents() is None


def test_a_silent_host_becomes_an_incident(spark, sf):
    from sigloom.sources.adapter import raw_lines

    raw = raw_lines(spark, sf)
    last = raw.agg(F.max("event_time")).first()[0]
    host = F.when(F.col("event_time") < F.lit(last - timedelta(hours=3)), "gone").otherwise("alive")
    r = batch.run(raw.withColumn("host", host).where(F.col("event_time") > F.lit(last - timedelta(hours=20))))
    silent = r.signals.where("signal_name = 'agent_silent'").collect()
    assert [s.entity_id for s in silent] == ["gone"]
    assert r.incidents.where("title = 'agent_silent on gone'").count() + r.assigned.where("signal_name = 'agent_silent' AND NOT founder").count() == 1
    assert {"event_count", "error_rate"} <= {x.feature_name for x in r.features.select("feature_name").distinct().collect()}
    assert features.entity_stats(r.features).where("entity_type = 'host'").agg(F.sum("event_count")).first()[0] == features.entity_stats(features.minute_rollup(r.normalized)).where("entity_type = 'host'").agg(F.sum("event_count")).first()[0]
