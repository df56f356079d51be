"""The generic ``events`` table seen as normalized events, and as raw log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigloom.session import spread


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, u, v, k = F.col("event_type"), F.col("user_id"), F.col("value"), F.col("k")
    by = lambda **x: F.create_map(*[F.lit(y) for kv in x.items() for y in kv])[t]
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("k", _k())
    rows = rows.withColumn("vendor", by(click="juiceshop", view="opnsense", error="wazuh", signup="windows", purchase="juiceshop"))
    rows = rows.withColumn("rule_id", F.when(t == "error", "4625").when(t == "signup", "4624").otherwise(F.substring(F.md5(t), 1, 8)))
    shop = F.col("vendor") == "juiceshop"
    signature = (
        F.when((t == "view") & (k % 2 == 0), "zenarmor:allowed:tcp:out")
        .when(t == "view", "ET POLICY test")
        .when((t == "error") & (k % 3 == 0), "sshd: authentication failed")
        .otherwise(F.concat(F.lit("EventCode="), F.col("rule_id")))
    )
    return rows.select(
        F.col("event_id").alias("raw_id"),
        F.col("ts").alias("event_time"),
        "vendor",
        F.when((t == "view") & (k % 2 == 1), "ids").otherwise(by(view="network", error="alert", signup="auth", click="web", purchase="web")).alias("event_kind"),
        F.lit("events").alias("source"),
        by(error="wazuh-alerts", click="juiceshop:app", purchase="juiceshop:app", view="opnsense:syslog", signup="WinEventLog").alias("sourcetype"),
        F.concat(F.lit("host_"), (u % 5).cast("string")).alias("host"),
        F.when(u % 11 != 0, F.concat(F.lit("10.0."), (u % 4).cast("string"), F.lit("."), (u % 200).cast("string"))).alias("src_ip"),
        F.lit(None).cast("string").alias("dest_ip"),
        F.when(u % 13 == 0, "").otherwise(F.concat(F.lit("user_"), u.cast("string"))).alias("username"),
        "rule_id",
        signature.alias("signature"),
        F.when(v >= 90, 7).when(v >= 60, 4).when(v >= 30, 1).otherwise(0).alias("severity"),
        F.lit(None).cast("string").alias("http_method"),
        F.when(shop, F.concat(F.lit("/p/"), (k % 6).cast("string"))).alias("http_path"),
        F.when(shop, F.when(k % 10 == 0, 500).when(k % 7 == 0, 404).otherwise(200)).alias("http_status"),
    )


#: The same projection for DuckDB, a common table expression named ev.
EV = """ev AS (SELECT event_id AS raw_id, ts AS event_time, vendor,
  CASE WHEN event_type = 'view' AND k % 2 = 1 THEN 'ids' ELSE CASE event_type WHEN 'view' THEN 'network' WHEN 'error' THEN 'alert' WHEN 'signup' THEN 'auth' ELSE 'web' END END AS event_kind,
  'events' AS source,
  CASE event_type WHEN 'error' THEN 'wazuh-alerts' WHEN 'view' THEN 'opnsense:syslog' WHEN 'signup' THEN 'WinEventLog' ELSE 'juiceshop:app' END AS sourcetype,
  'host_' || (user_id % 5) AS host,
  CASE WHEN user_id % 11 <> 0 THEN '10.0.' || (user_id % 4) || '.' || (user_id % 200) END AS src_ip,
  CAST(NULL AS VARCHAR) AS dest_ip,
  CASE WHEN user_id % 13 = 0 THEN '' ELSE 'user_' || user_id END AS username,
  rule_id,
  CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'zenarmor:allowed:tcp:out' WHEN event_type = 'view' THEN 'ET POLICY test'
       WHEN event_type = 'error' AND k % 3 = 0 THEN 'sshd: authentication failed' ELSE 'EventCode=' || rule_id END AS signature,
  CASE WHEN value >= 90 THEN 7 WHEN value >= 60 THEN 4 WHEN value >= 30 THEN 1 ELSE 0 END AS severity,
  CAST(NULL AS VARCHAR) AS http_method,
  CASE WHEN vendor = 'juiceshop' THEN '/p/' || (k % 6) END AS http_path,
  CASE WHEN vendor = 'juiceshop' THEN CASE WHEN k % 10 = 0 THEN 500 WHEN k % 7 = 0 THEN 404 ELSE 200 END END AS http_status
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
   CASE event_type WHEN 'view' THEN 'opnsense' WHEN 'error' THEN 'wazuh' WHEN 'signup' THEN 'windows' ELSE 'juiceshop' END AS vendor,
   CASE event_type WHEN 'error' THEN '4625' WHEN 'signup' THEN '4624' ELSE substr(md5(event_type), 1, 8) END AS rule_id
  FROM events))"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events in the formats of five log sources, one row for each event; see :data:`RAW`."""
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("k", _k())
    t, u, k, e = F.col("event_type"), F.col("user_id").cast("string"), F.col("k"), F.col("event_id")
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    ks = k.cast("string")
    ip = text("10.1.", (F.col("user_id") % 300).cast("string"), ".7")
    status = F.when(k % 10 == 0, "500").otherwise("200")
    line = (
        F.when(t == "click", text(ip, ' - - [01/Jan/2024:00:00:00 +0000] "GET /p/', ks, " HTTP/1.1\" ", status, " 12"))
        .when(t == "purchase", F.when(k % 2 == 0, text("error: order ", ks, " of user ", u, " could not be placed, try it again")).otherwise(text("info: order ", ks)))
        .when((t == "view") & (k % 2 == 1), text("suricata 77 - [1:", ks, ":3] ET SCAN probe ", ks, " [Classification: Misc] [Priority: ", (k % 3 + 1).cast("string"), "] {TCP} ", ip, ":99 -> 10.9.9.9:80"))
        .when(t == "view", text('fw zenarmor: {"is_blocked":', (k % 4 == 0).cast("int").cast("string"), ',"app_proto":"dns","direction":"out","src_ip":"', ip, '","dst_ip":"10.2.2.2"}'))
        .when(t == "error", text("LogName=Security\r\nSourceName=Security-Auditing\r\nEventCode=4625\r\nAccount Name: ", F.when(k % 5 == 0, text("FAIL_LAB_BURST_", u)).otherwise(text("user_", u)), "\r\nSource Address: ", ip, "\r\n"))
        .otherwise(text("<Event EventCode=4624><Data Name='TargetUserName'>-</Data><Data Name='TargetUserName'>user_", u, "</Data></Event> SourceIp: ", ip, " DestinationIp: 10.3.3.3"))
    )
    kind = F.create_map(*[F.lit(x) for kv in {"click": "juiceshop:nginx", "purchase": "juiceshop:app", "view": "opnsense:syslog", "error": "wazuh-alerts", "signup": "XmlWinEventLog:Sysmon"}.items() for x in kv])[t]
    return rows.select(
        e.alias("id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        kind.alias("sourcetype"),
        F.lit("udp:514").alias("source"),
        F.when(e % 17 == 0, " 0.05 ").when(e % 19 == 0, "collector:8088").otherwise(text("h", (F.col("user_id") % 3).cast("string"))).alias("host"),
        F.when(t == "error", text('{"Type":["Error","x"],"rule":{"level":', (k % 16).cast("string"), ',"id":"5710","groups":["sshd"]}}')).otherwise(text('{"k":', ks, "}")).alias("raw_json"),
        line.alias("raw_text"),
    )


#: What those lines say, for DuckDB: ids, addresses and kinds straight from the fields.
RAW = """raw AS (SELECT event_id, ts, event_type AS t, user_id AS u, k, '10.1.' || (user_id % 300) || '.7' AS ip,
   CASE event_id % 17 WHEN 0 THEN 'unknown' ELSE CASE WHEN event_id % 19 = 0 THEN 'collector:8088' ELSE 'h' || (user_id % 3) END END AS host
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
