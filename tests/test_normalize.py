"""Rows for each rule, and the captured samples' shapes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sigloom.functions import columns as K
from sigloom.operators import normalize as N
from sigloom.params import Compat

RAW = "id long, event_time timestamp, sourcetype string, source string, host string, raw_json string, raw_text string"
T = datetime(2025, 12, 21, 16, 35)


def run(spark, *rows, compat=None):
    """rows: (sourcetype, source, host, raw_json, raw_text)"""
    raw = spark.createDataFrame([(i, T, *r) for i, r in enumerate(rows)], RAW)
    return N.normalize(raw, compat or Compat()).orderBy("raw_id").collect()


def one(spark, *row, compat=None):
    return run(spark, row, compat=compat)[0]


def test_sample_shapes(spark):
    win = "12/21/2025 04:35:00 PM\r\nLogName=Security\r\nEventCode=5156\r\nSource Address:\t\t127.0.0.1\r\nDestination Address:\t127.0.0.1\r\n"
    sysmon = "EventCode=3\r\nUser: NT AUTHORITY\\NETWORK SERVICE\r\nSourceIp: 224.0.0.251\r\nDestinationIp: 192.168.10.50\r\n"
    web = '192.168.10.20 - - [21/Dec/2025:16:35:00 +0000] "GET /socket.io/?EIO=4 HTTP/1.1" 200 1 "-" "x"'
    a, b, c, d, e = run(
        spark,
        ("WinEventLog", "WinEventLog:Security", "DC", "{}", win),
        ("WinEventLog", "WinEventLog:Microsoft-Windows-Sysmon/Operational", "DC", "{}", sysmon),
        ("opnsense:syslog", "udp:5514", "192.168.10.2", "{}", "Dec 21 16:35:00 192.168.10.2 filterlog: x"),
        ("nginx:access", "/var/log/access.log", "juiceshop", "{}", web),
        (None, None, None, "{}", '{"wazuh": {}}'),
    )
    assert (a.vendor, a.event_kind, a.host, a.src_ip, a.dest_ip, a.username, a.rule_id, a.signature, a.severity) == ("windows", "network", "DC", "127.0.0.1", "127.0.0.1", None, "5156", "EventCode=5156", 0)
    assert (b.vendor, b.event_kind, b.src_ip, b.dest_ip, b.username, b.rule_id) == ("sysmon", "network", "224.0.0.251", "192.168.10.50", "NT AUTHORITY\\NETWORK SERVICE", "3")
    assert (c.vendor, c.event_kind, c.src_ip, c.rule_id, c.signature) == ("opnsense", "network", "192.168.10.2", "21da10d5", "opnsense:network")
    assert (d.vendor, d.src_ip, d.http_method, d.http_path, d.http_status, d.rule_id, d.signature) == ("juiceshop", "192.168.10.20", "GET", "/socket.io/?EIO=4", 200, "7e430bf6", "GET /socket.io/?EIO=4")
    assert (e.vendor, e.event_kind, e.rule_id, e.signature, e.severity) == ("unknown", "unknown", "06942fbc", "unknown:unknown", 0)


@pytest.mark.parametrize(
    "st, src, want",
    [
        ("wazuh-alerts", "firebase", ("wazuh", "alert")),
        ("suricata", "udp:5514", ("opnsense", "network")),
        ("zenarmor", "udp:5514", ("opnsense", "network")),
        ("juiceshop:app", "http:8088", ("juiceshop", "web")),
        ("XmlWinEventLog", "x", ("windows", "event")),
        (None, None, ("unknown", "unknown")),
    ],
)
def test_classes(spark, st, src, want):
    c = N.classify(F.lit(st), F.lit(src))
    assert tuple(spark.range(1).select(c["vendor"], c["kind"]).first()) == want


def test_noise_and_time(spark):
    raw = spark.createDataFrame([(1, T, "x", "x", "h", "{}", "0.00      0.00"), (2, T, "x", "x", "h", "{}", "12/21/2025 a"), (3, None, "x", "x", "h", '{"_time":"2025-01-01 10:00:00 SAST"}', "x"), (4, None, "x", "x", "h", "broken", "x")], RAW)
    got = {r.raw_id: r.event_time for r in N.normalize(raw).collect()}
    assert got == {2: T, 3: datetime(2025, 1, 1, 8)}
    assert {(r.raw_id, r.reason) for r in N.rejected(raw).collect()} == {(1, "metric line"), (4, "no time")}


def test_windows_rules(spark):
    w = lambda j, text="": one(spark, "wazuh-alerts", "s", "h", j, text)
    assert [w(j).severity for j in ('{"Type":"Error"}', '{"Type":["Information","Not persistent"]}', '{"Level":"Warning"}', '{"rule":{"level":12}}', '{"rule":{"level":7}}', '{"rule":{"level":6}}', '{"rule":{"level":0}}', '{"rule":{"level":"0"}}', '{"rule":{"level":"x"}}')] == [7, 1, 4, 7, 4, 1, 0, 1, 0]
    r = w('{"rule":{"id":"5710","level":5,"description":"SSHD attempt"},"data":{"srcip":"1.2.3.4"}}')
    assert (r.signature, r.rule_id, r.severity, r.event_kind, r.src_ip) == ("SSHD attempt", "5710", 1, "alert", None)
    assert w('{"rule":{"level":5}}').rule_id != "None"
    assert one(spark, "wazuh-alerts", "s", "h", '{"rule":{"level":5}}', "", compat=Compat(none_as_null=False)).rule_id == "None"
    assert one(spark, "WinEventLog", "s", "h", '{"rule":{"groups":["a","authentication_failed"]}}', "").event_kind == "alert"
    r = w('{"EventCode":4625,"rule":{"level":12}}', "Account Name: bob")
    assert (r.rule_id, r.severity, r.event_kind, r.username, r.signature) == ("4625", 2, "alert", "bob", "EventCode=4625")
    r = w('{"EventCode":"4625"}', "User: FAIL_LAB_BURST_V3_5_x")
    assert (r.severity, r.event_kind) == (7, "alert")
    xml = "<D Name='TargetUserName'>{}</D><D Name='TargetUserName'>{}</D> User: eve"
    assert [w("{}", xml.format(*x)).username for x in (("-", "bob"), ("-", "-"), (" ann ", "x"))] == ["bob", "eve", "ann"]
    assert w("{}", "SourceName=Sec \r\n").signature == "SourceName=Sec"
    assert w('{"Message":"EventCode=4624"}', "EventCode=1").event_kind == "auth"


def test_web_rules(spark):
    w = lambda text, j="{}", host=None, **c: one(spark, "juiceshop:app", "s", host, j, text, compat=Compat(**c))
    assert w("a" * 50).signature == "a" * 50 and w("a" * 51).signature == "a" * 50 + ".."
    assert [(r.event_kind, r.severity) for r in (w("error: x"), w("warn: x"), w("info: x"))] == [("alert", 7), ("web", 4), ("web", 0)]
    assert [w("x", j, h).host for j, h in (("{}", None), ('{"dvc":"d"}', "unknown"), ('{"container_name":"c"}', ""), ("{}", "mine"))] == ["juiceshop", "d", "c", "mine"]
    assert w("x", '{"clientip":"9.8.7.6"}').src_ip == "9.8.7.6"
    body = '{"method":"GET","path":"/rest","statusCode":500,"user":"u"}'
    assert w(body).http_path is None
    assert (w(body, nested_app_json=True).http_path, w(body, nested_app_json=True).http_status) == ("/rest", 500)


def test_firewall_rules(spark):
    w = lambda text, j="{}": one(spark, "suricata", "udp:5514", "fw", j, text)
    line = "suricata 4011 - [1:2:3] ET TROJAN X [Classification: y] [Priority: {}] {{TCP}} 1.2.3.4:1 -> 5.6.7.8:2"
    assert [(r.event_kind, r.severity, r.rule_id, r.signature, r.src_ip) for r in (w(line.format(p)) for p in (1, 2, 3))] == [(k, s, "1:2:3", "ET TROJAN X", "1.2.3.4") for k, s in (("alert", 7), ("alert", 4), ("ids", 1))]
    r = w("x 9.9.9.9", '{"src_ip":"10.0.0.5","dest_ip":"8.8.8.8","alert":{"signature":"S","severity":1}}')
    assert (r.event_kind, r.src_ip, r.dest_ip, r.signature, r.severity) == ("ids", "10.0.0.5", "8.8.8.8", "S", 0)
    assert w("x 9.9.9.9", '{"alert":{"signature":"S"}}').src_ip is None
    r = w('7.7.7.7 zenarmor: {"is_blocked":1,"app_proto":"dns","direction":"out","src_ip":"1.2.3.4","dst_ip":"5.6.7.8"}')
    assert (r.signature, r.rule_id, r.event_kind, r.severity, r.src_ip, r.dest_ip) == ("zenarmor:blocked:dns:out", "flow:dns", "alert", 4, "1.2.3.4", "5.6.7.8")
    r = w('7.7.7.7 zenarmor: {"transport_proto":"tcp"}')
    assert (r.signature, r.event_kind, r.src_ip) == ("zenarmor:allowed:tcp:unknown", "network", "7.7.7.7")
    r = w('zenarmor: {"broken action allowed zenarmor.check')
    assert (r.signature, r.rule_id, r.event_kind) == ("allowed zenarmor.check", "zenarmor.check", "network")
    assert w("x", '{"event_type":"flow"}').signature == "flow"
    assert w("x", '{"_raw":"y 4.4.4.4"}').src_ip == "4.4.4.4"


def test_final_rules(spark):
    assert one(spark, "x", "x", " 0.05 ", "{}", "t").host == "unknown"
    assert one(spark, "x", "x", "10.0.0.1", "{}", "t").host == "10.0.0.1"
    r = one(spark, "x", "x", "a:8088", "{}", "t")
    assert (r.vendor, r.event_kind, r.severity, r.signature) == ("infra", "metric", 0, "pipeline_noise")
    got = spark.createDataFrame([(x,) for x in ("-", "0", "256.1.1.1", "001.2.3.4", " 1.2.3.4 ", "::1", "", None)], "a string").select(K.ipv4(F.col("a")), K.ipv4(F.col("a"), True)).collect()
    assert [r[0] for r in got] == [None, None, None, "001.2.3.4", "1.2.3.4", None, None, None] and got[4][1] == "1.2.3.4/32"


def test_times_and_keys(spark):
    text = {"1766334900": T, "1766334900.5": datetime(2025, 12, 21, 16, 35, 0, 500000), "2025-12-21T16:35:00Z": T, "2025-12-21T18:35:00+02:00": T, "2025-12-21 16:35:00.000 UTC": T, "2025-12-21 18:35:00 CAT": T, "2025-12-21 16:35:00": T, "2025": datetime(1970, 1, 1, 0, 33, 45), "12d": None, "garbage": None, "2025-12-21 16:35:00 EST": None, "": None}
    rows = spark.createDataFrame([(k,) for k in text] + [(None,)], "s string").select("s", K.event_time(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == text | {None: None}
    iso = spark.sql("SELECT TIMESTAMP '2025-01-02 03:04:05' AS a, TIMESTAMP '2025-01-02 03:04:05.25' AS b").select(K.iso_time(F.col("a")), K.iso_time(F.col("b"))).first()
    assert tuple(iso) == ("2025-01-02T03:04:05+00:00", "2025-01-02T03:04:05.250000+00:00")


def test_extras_and_inner_json(spark):
    df = spark.createDataFrame([('{"_raw":"{\\"a\\":{\\"b\\":3}}","_cd":"1","x":2}',)], "j string")
    assert df.select(N.extras(F.col("j"))).first()[0] == {"x": "2"}
    assert df.select(N.inner_json(F.parse_json("j"), "$.a.b").cast("int")).first()[0] == 3
    assert df.select(N.key_values(F.lit("a=1\nb = x=y\n\na=2"))).first()[0] == {"a": "2", "b": "x=y"}


def test_broken_and_repeated_payloads_stay(spark):
    """Batch and stream keep the same rows: what can't be parsed counts as an empty object, of a repeated key the last value."""
    from sigloom.streaming.pipeline import _keyed

    rows = [(i, "2025-01-01 00:00:00", "WinEventLog", "s", "h", p, "EventCode=7") for i, p in enumerate(['{"EventCode":"1"}', '{"EventCode":', '{"EventCode":"1","EventCode":"2"}', "[1,2]", "", None])]
    raw = spark.createDataFrame(rows, "id long, event_time string, sourcetype string, source string, host string, raw_json string, raw_text string").withColumn("event_time", F.col("event_time").cast("timestamp"))
    got = {r.raw_id: r.rule_id for r in N.normalize(raw).collect()}
    assert got == {0: "1", 1: "7", 2: "2", 3: "7", 4: "7", 5: "7"}
    assert {r.raw_id: r.rule_id for r in _keyed(raw.withColumn("event_key", F.col("id").cast("string")), N.DEFAULT).collect()} == got
    assert [tuple(r) for r in N.rejected(raw).collect()] == [(1, "broken payload")]
