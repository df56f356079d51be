"""Streamed detection and correlation against the same over stored tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigloom.operators import correlate, detect
from sigloom.plans import batch
from sigloom.sources.adapter import normalized_events, raw_lines
from sigloom.streaming import detect as streamed
from sigloom.streaming import pipeline

from .test_engine import SIGNALS, plain_fold, signal

WIDE = detect.Baselines(current=timedelta(days=7), baseline=timedelta(days=10), quiet=timedelta(hours=9), least=2, factor=0.9)
FAR = datetime(2025, 6, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    old = spark.conf.get(pipeline.ROCKS[0])
    spark.conf.set(*pipeline.ROCKS)
    yield
    spark.conf.set(pipeline.ROCKS[0], old)


def in_files(rows, path, seed, files=4, minutes=40):
    """Rows in order of a time that is off by up to so many minutes, a file after the other, and a last one far in the future."""
    rng = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(minutes * 60))
    off = rows.withColumn("__at", F.unix_seconds("event_time") + rng)
    cuts = off.approxQuantile("__at", [i / files for i in range(1, files)], 0.0)
    for i, (a, b) in enumerate(zip([0.0, *cuts], [*cuts, 1e12], strict=True)):
        off.where((F.col("__at") >= a) & (F.col("__at") < b)).drop("__at").coalesce(1).write.parquet(f"{path}/{i}")
    last = rows.limit(1).withColumns({"event_time": F.lit(FAR).cast("timestamp"), "id": F.lit(-1).cast("long"), "host": F.lit("heartbeat")})
    if "event_key" in rows.columns:
        last = last.withColumn("event_key", F.lit("last"))
    last.coalesce(1).write.parquet(f"{path}/{files}")


def finished(df, path):
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(600)
    assert q.exception() is None
    return df.sparkSession.read.parquet(f"{path}/out")


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_baselines_equal_batch(spark, sf, tmp_path):
    events = normalized_events(spark, sf).withColumns({"event_time": F.col("event_time").cast("timestamp"), "id": F.col("raw_id")})
    in_files(events, tmp_path / "in", 1)
    got = finished(streamed.baseline_stream(source(spark, events.schema, tmp_path / "in").withWatermark("event_time", "60 minutes"), WIDE), tmp_path)
    table = batch.feature_table(events)
    want = detect.judged(detect.swept(table, FAR - timedelta(hours=1), WIDE), WIDE)
    a, b = ({r.dedupe_key: (r.window_start, r.window_end, r.severity, round(r.score, 9), r.metadata) for r in x.collect()} for x in (got, want))
    assert {k.split("|")[0] for k in b} == {"auth_fail_spike", "agent_silent", "app_error_spike"}
    assert a == b and got.count() == len(a)


def test_state_is_empty_after_expiry(spark, sf, tmp_path):
    events = normalized_events(spark, sf).withColumns({"event_time": F.col("event_time").cast("timestamp"), "id": F.col("raw_id")})
    in_files(events, tmp_path / "in", 2)
    finished(streamed.baseline_stream(source(spark, events.schema, tmp_path / "in").withWatermark("event_time", "60 minutes")), tmp_path)
    for name in ("last", "bins"):
        left = spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/cp")
        assert left.count() == 0


def test_raw_lines_to_incidents_equal_batch(spark, sf, tmp_path):
    raw = raw_lines(spark, sf).withColumn("event_key", F.concat(F.lit("k"), "id"))
    in_files(raw, tmp_path / "in", 3, files=3)
    events = pipeline.normalized_stream(source(spark, raw.schema, tmp_path / "in"))
    got = finished(streamed.correlated_stream(streamed.signal_stream(events, WIDE, hours=2), 120), tmp_path)
    table = batch.run(raw)
    want = correlate.assign(batch.swept_signals(table.features, table.normalized, FAR - timedelta(hours=1), WIDE, hours=2))
    a, b = ({r.dedupe_key: (r.incident_id, r.founder, r.window_start, round(r.score, 9), r.severity, r.metadata) for r in x.collect()} for x in (got, want))
    assert a == b and len(a) > 20 and got.count() == len(a)
    x, y = (correlate.incidents(i).drop("score") for i in (got, want))
    assert x.exceptAll(y.select(*x.columns)).count() == 0 and x.count() == y.count()


def test_correlation_waits_for_late_signals(spark, tmp_path):
    rng = random.Random(9)
    rows = [signal(f"k{i:04}", rng.randrange(0, 3000), f"h{rng.randrange(5)}") for i in range(400)]
    frame = spark.createDataFrame(rows, SIGNALS)
    shuffled = frame.withColumn("id", F.xxhash64("dedupe_key"))
    in_files(shuffled, tmp_path / "in", 5, minutes=55)
    stream = source(spark, shuffled.schema, tmp_path / "in").withColumn("ready", F.col("event_time")).withWatermark("ready", "60 minutes")
    got = finished(streamed.correlated_stream(stream), tmp_path).where(F.col("window_end") < F.lit(FAR - timedelta(days=1)))
    found = {r.dedupe_key: r.incident_id for r in got.collect()}
    want = plain_fold(rows)
    assert found == want
    for name in ("open", "waiting"):
        left = spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/cp")
        assert left.count() <= 1  # the last, far signal may wait


def test_top_addresses_equal_batch(spark, sf, tmp_path):
    """Update mode: the last row of each bin, host and rank is what the batch has; nothing is left when the bins are over."""
    events = normalized_events(spark, sf).withColumns({"event_time": F.col("event_time").cast("timestamp"), "id": F.col("raw_id"), "src_ip": F.concat(F.lit("10.0.0."), F.col("raw_id") % 9)})
    in_files(events, tmp_path / "in", 7, files=6)
    hours = 48 * 3600
    stream = streamed.top_src_ip_stream(source(spark, events.schema, tmp_path / "in").withWatermark("event_time", "60 minutes"), hours, 3)
    q = stream.writeStream.outputMode("update").foreachBatch(pipeline.keep_features(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    from sigloom.operators.features import top_src_ips
    from sigloom.operators.state import latest_per_key

    kept = latest_per_key(spark.read.parquet(str(tmp_path / "out")), ["bin_start", "host", "rank"], "batch").drop("batch").where("host <> 'heartbeat'")
    want = top_src_ips(events, hours, 3).select(*kept.columns)
    assert kept.count() == want.count() > 50 and kept.exceptAll(want).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > want.count()  # some rank was taken over
    assert spark.read.format("statestore").option("stateVarName", "counts").load(f"{tmp_path}/cp").count() <= 1


def test_then_gets_the_rows_of_its_batch(spark, sf, tmp_path):
    rows = normalized_events(spark, sf).select("host").limit(8)
    seen = []
    put = pipeline.keep_features(str(tmp_path / "f"), lambda x: seen.append(x.count()))
    for i in range(3):
        put(rows.limit(i + 1), i)
    assert seen == [1, 2, 3]
