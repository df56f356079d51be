"""Properties of the stages, the stateful fold, the stream and the export source."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigloom.operators import correlate, detect, features, serve, state
from sigloom.plans import batch, rollups
from sigloom.sources.adapter import normalized_events, raw_lines
from sigloom.sources.export import SearchExport, SessionKey, database_url, search_text
from sigloom.sources.files import envelope
from sigloom.streaming import pipeline as stream

SIGNALS = "event_time timestamp, window_start timestamp, window_end timestamp, signal_name string, entity_type string, entity_id string, severity int, score double, dedupe_key string, metadata string"
T = datetime(2025, 1, 1)


def signal(key, minutes, entity="h", span=0, score=10.0, severity=4):
    end = T + timedelta(minutes=minutes)
    return (end, end - timedelta(minutes=span), end, "s", "host", entity, severity, score, key, "{}")


def plain_fold(rows):
    """Candidate lists, as a table lookup for each signal would do."""
    incidents, out = [], {}
    for _, start, end, _, kind, name, _, _, key, _ in sorted(rows, key=lambda r: (r[2], r[8])):
        able = [x for x in incidents if x["e"] == (kind, name) and x["last"] >= end - timedelta(minutes=30) and x["start"] >= end - timedelta(hours=4)]
        if able:
            x = max(able, key=lambda x: x["last"])
            x["last"] = max(x["last"], end)
        else:
            x = {"e": (kind, name), "start": start, "last": end, "id": key}
            incidents.append(x)
        out[key] = x["id"]
    return out


def test_fused_features_equal_separate_ones(spark, sf):
    events = normalized_events(spark, sf)
    a, b = features.minute_rollup(events), features.minute_rollup_apart(events)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 1000


def test_lookback_counts_whole_bins(spark, sf):
    events = normalized_events(spark, sf)
    at = events.agg(F.max("event_time")).first()[0] + timedelta(seconds=20)
    full = features.minute_rollup(events)
    for compat, whole in ((features.Compat(), True), (features.Compat(align_bins=False), False)):
        part = features.minute_rollup(events, as_of=F.lit(at), lookback_minutes=6000, compat=compat)
        assert part.count() > 10 and (part.exceptAll(full).count() == 0) >= whole


def test_fold_matches_lookups(spark):
    rng = random.Random(5)
    rows = [signal(f"k{i:04}", rng.randrange(0, 6000), f"h{rng.randrange(12)}", rng.choice([0, 0, 5, 300])) for i in range(2500)]
    got = correlate.assign(spark.createDataFrame(rows, SIGNALS).repartition(6)).collect()
    assert {r.dedupe_key: r.incident_id for r in got} == plain_fold(rows)
    assert all(r.founder == (r.dedupe_key == r.incident_id) for r in got)


def test_fold_boundaries_and_scores(spark):
    us = timedelta(microseconds=1)
    gap = [signal("a", 0, "gap"), signal("b", 30, "gap"), signal("c", 60, "late")]
    late = list(signal("d", 90, "late"))
    late[1] = late[2] = late[2] + us
    cap = [signal(f"m{i:02}", 20 * i, "cap") for i in range(14)]
    long = [signal("x", 0, "long", 300), signal("y", 5, "long")]
    score = [signal("p", 0, "score", 0, 200.0, 3), signal("q", 10, "score", 0, 60.0, 7)]
    a = correlate.assign(spark.createDataFrame([*gap, tuple(late), *cap, *long, *score], SIGNALS))
    of = {r.dedupe_key: r.incident_id for r in a.collect()}
    assert of["b"] == "a" and of["d"] == "d"
    assert {of[f"m{i:02}"] for i in range(13)} == {"m00"} and of["m13"] == "m13"
    assert of["y"] == "y"
    top = correlate.incidents(a).where("incident_id = 'p'").first()
    assert (top.score, top.severity, top.title, top.status) == (250.0, 7, "s on score", "NEW")
    assert correlate.evidence(a).count() == a.count()


def test_spike_thresholds(spark):
    def table(name, values, kind="host"):
        return spark.createDataFrame([(T + timedelta(minutes=m), 60, "v", name, kind, e, "-", "-", float(v), int(v)) for e, m, v in values], "bin_start timestamp, bin_size_sec int, vendor string, feature_name string, entity_type string, entity_id string, secondary_type string, secondary_id string, value double, n_events int")

    bad = table("bad_event_count", [("a", 0, 50), ("b", 0, 30), ("b", 9, 21)])
    assert [(r.entity_id, r.score, r.window_end) for r in detect.bad_event_spikes(bad).collect()] == [("b", 51.0, T + timedelta(minutes=9))]
    fails = table("auth_fail_count", [("a", 400, 4), ("b", 400, 5), ("c", 400, 6), ("d", 400, 11), ("d", 100, 2), ("e", 400, 12), ("e", 100, 2)])
    hits = detect.auth_fail_spikes(fails, T + timedelta(minutes=410))
    assert sorted(r.entity_id for r in hits.collect()) == ["c", "e"]
    assert hits.where("entity_id = 'c'").first().dedupe_key == "auth_fail_spike|host|c|20250101065000"
    alive = table("event_count", [("a", 0, 1), ("b", 0, 1), ("b", 1400, 1), ("(none)", 0, 1)])
    assert [r.entity_id for r in detect.silent_agents(alive, T + timedelta(minutes=1410)).collect()] == ["a"]
    rates = table("error_rate", [("(none)", 400, 1), ("/x", 400, 1), ("/x", 100, 1)], "endpoint")
    assert [r.entity_id for r in detect.app_error_spikes(rates, T + timedelta(minutes=410)).collect()] == ["juiceshop_global"]


def test_promotion(spark):
    rows = [(T, "opnsense", "ids", "1:2:3", "X", 1, "fw", "1.2.3.4", None), (T, "opnsense", "alert", "1", "Y", 4, "fw", "1.2.3.4", None), (T, "opnsense", "ids", "1", None, 0, "fw", None, None), (T, "wazuh", "alert", "1", "Z", 7, "unknown", None, None)]
    got = detect.promoted_alerts(spark.createDataFrame(rows, "event_time timestamp, vendor string, event_kind string, rule_id string, signature string, severity int, host string, src_ip string, dest_ip string"))
    assert sorted((r.signal_name, r.entity_type, r.entity_id, r.severity) for r in got.collect()) == [("X", "ip", "1.2.3.4", 1), ("opnsense Alert", "host", "fw", 4)]


def test_windows_and_checkpoints():
    now = datetime(2025, 1, 1, 10, 5, 40)
    assert detect.window_of(None, now) == (datetime(2025, 1, 1, 9, 5), datetime(2025, 1, 1, 10, 5))
    assert detect.advanced(now, now - timedelta(hours=1)) == now


def test_append_and_upsert_are_idempotent(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "k string, n long")
    empty = rows.limit(0)
    once = state.append_new(empty, rows, ["k"], ["n"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 1)]
    assert state.append_new(once, rows, ["k"], ["n"]).count() == 0
    up = state.upserted(once, spark.createDataFrame([("a", 9), ("c", 3)], "k string, n long"), ["k"])
    assert sorted(map(tuple, up.collect())) == [("a", 9), ("b", 1), ("c", 3)]


def test_briefs(spark):
    a = correlate.assign(spark.createDataFrame([signal("a", 0, score=70.0), signal("b", 10), signal("c", 10)], SIGNALS))
    inc, line = correlate.incidents(a), serve.incident_evidence(a.drop("incident_id", "founder"), correlate.evidence(a))
    stats, key = serve.brief_stats(line).first(), serve.key_evidence(line).orderBy("rank").collect()
    assert (stats.total_signals, stats.unique_evidence, len(key)) == (3, 2, 2)
    text = serve.heuristic_brief(inc.first(), stats, key)
    assert "host:h" in text and "3 signals, 2 distinct" in text and "02:10:00" in text
    assert serve.written_brief(inc.first(), stats, key, lambda p: "own") == "own"
    assert "failed" in serve.written_brief(inc.first(), stats, key, lambda p: 1 / 0) and serve.heuristic_brief(None, None, []).startswith("No evidence")
    assert len(serve.investigation_queries("host", "a'b", "x", "y")) == 2 and serve.investigation_queries("endpoint", "x", "a", "b") == []


def test_batch_job_and_stored_tables(spark, sf, tmp_path):
    raw = raw_lines(spark, sf).withColumn("event_key", F.concat(F.lit("k"), "id"))
    r = batch.run(raw.union(raw))
    assert r.normalized.count() == raw.count() and r.rejected.count() == 0
    assert r.incidents.count() > 10 and r.evidence.count() == r.signals.count()
    batch.store(r.features, str(tmp_path / "f"), "bin_start")
    again = batch.load(spark, str(tmp_path / "f"))
    assert again.count() == r.features.count()
    day = r.features.where("to_date(bin_start) = DATE '2024-01-03'")
    batch.store(day, str(tmp_path / "f"), "bin_start")
    assert batch.load(spark, str(tmp_path / "f")).count() == r.features.count()
    one = batch.load(spark, str(tmp_path / "f"), F.lit(datetime(2024, 1, 3)), F.lit(datetime(2024, 1, 3)))
    assert one.count() == day.count()


def test_stream_equals_batch(spark, sf, tmp_path):
    raw = raw_lines(spark, sf).withColumn("event_key", F.concat(F.lit("k"), "id")).orderBy("event_time")
    raw.union(raw).repartition(1).sortWithinPartitions("event_time").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    rolled = stream.feature_stream(stream.normalized_stream(source))
    q = rolled.writeStream.outputMode("update").foreachBatch(stream.keep_features(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = stream.latest_features(spark.read.parquet(str(tmp_path / "out"))).select(*features.COLUMNS)
    want = batch.run(raw).features
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def fake_transport(search, start, end):
    """Lines of a fake server: an event a second, and some noise."""
    assert search.startswith("search")
    for i in range(int(start), int(end)):
        yield json.dumps({"preview": False, "result": {"_cd": f"1:{i}", "_time": str(i), "host": "h"}})
    yield "not json"
    yield b'{"preview": true}'


def test_export_source(spark, tmp_path):
    spark.dataSource.register(SearchExport)
    options = {"transport": f"{__name__}:fake_transport", "end": "50", "splits": "4"}
    events = envelope(spark.read.format("search_export").options(**options).load())
    assert events.count() == 50 and events.select("event_key").distinct().count() == 50
    assert spark.read.format("search_export").options(**{**options, "unwrap": "false"}).load().count() == 54
    assert spark.read.format("search_export").options(**{**options, "splits": "1", "limit": "1"}).load().count() == 1
    assert spark.read.format("search_export").options(**{**options, "limit": "7"}).load().count() == 7  # of the whole pull
    q = spark.readStream.format("search_export").options(**{**options, "limit": "0"}, start="0", step="20").load().writeStream.format("memory").queryName("exported").start()
    q.processAllAvailable()
    for _ in range(4):
        q.processAllAvailable()
    q.stop()
    assert spark.table("exported").select("event").distinct().count() >= 20


def test_small_helpers():
    t = [0.0]
    keys = iter("ab")
    key = SessionKey(lambda: next(keys), lambda: t[0])
    assert (key(), key()) == ("a", "a")
    t[0] = 1800.0
    assert key() == "b"
    assert database_url("postgresql+psycopg2://u@h/d") == "postgresql://u@h/d"
    assert search_text(["a", "b"], 5, 10) == "search (index=a OR index=b) earliest=-5m | fields * | head 10"


@pytest.mark.parametrize("status, colour", [("NEW", "danger"), ("x", "secondary"), (None, "secondary")])
def test_colours(spark, status, colour):
    assert spark.range(1).select(serve.status_colour(F.lit(status).cast("string"))).first()[0] == colour


def test_tag_queries_read_all_events(spark, sf):
    tagged = rollups.tagged(spark, sf)
    assert tagged.count() == normalized_events(spark, sf).count()
    assert 0 < sum(r.n for r in serve.tagged_counts(tagged, "lab_host").collect()) < tagged.count()


class _Server:
    """An export endpoint: a login, then one line for each ten seconds of the range."""

    def __enter__(self):
        import http.server
        import json
        import threading
        import urllib.parse

        seen = self.seen = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
                seen.append((self.path, self.headers.get("Authorization")))
                self.send_response(200)
                self.end_headers()
                if self.path.endswith("login"):
                    self.wfile.write(json.dumps({"sessionKey": "k1" if form["password"] == "p" else "no"}).encode())
                    return
                at = range(int(float(form["earliest_time"])), int(float(form["latest_time"])), 10)
                self.wfile.write("".join(json.dumps({"result": {"_time": str(x), "q": form["search"]}}) + "\n" for x in at).encode())

            def log_message(self, *a):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *a):
        self.server.shutdown()


def test_export_over_http(spark):
    spark.dataSource.register(SearchExport)
    with _Server() as server:
        options = {"url": f"http://127.0.0.1:{server.server.server_port}/", "username": "u", "password": "p", "search": "search x", "start": "0", "end": "200", "splits": "4"}
        got = spark.read.format("search_export").options(**options).load()
        assert sorted(r.event for r in got.collect())[0] == '{"_time": "0", "q": "search x"}' and got.count() == 20
        assert all(key == "Bearer k1" for path, key in server.seen if path.endswith("export")) and any(p.endswith("login") for p, _ in server.seen)
        q = spark.readStream.format("search_export").options(**options, step="50").load().writeStream.format("memory").queryName("over_http").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table("over_http").count() == 20


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    from sigloom.operators import state

    rows = spark.range(5000).selectExpr("id % 2 AS k", "5000 - id AS o", "id AS v")
    assert sorted(map(tuple, state.first_per_key(rows, ["k"], ["o"]).collect())) == [(0, 2, 4998), (1, 1, 4999)]
    assert sorted(map(tuple, state.latest_per_key(rows, ["k"], "v").collect())) == [(0, 2, 4998), (1, 1, 4999)]
    plan = state.first_per_key(rows, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_one_scan_for_the_five_minute_rollup(spark, sf):
    from sigloom.operators import features
    from sigloom.sources.adapter import normalized_events

    plan = features.five_minute_rollup(normalized_events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
