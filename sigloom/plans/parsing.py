"""Queries of the normalizing and envelope operators, with their SQL.

Lines in five log formats are built from the events; what they must parse to follows from the
fields they were built of, so the SQL needs no parser of its own.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigloom.functions import columns as K
from sigloom.operators import normalize as N, state as S
from sigloom.sources import files as I
from sigloom.sources.adapter import EV, RAW, _k, normalized_events, raw_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def lines(kind: str):
    """Raw lines of one kind of event, with the event's number of its props."""
    def rows(spark: SparkSession, d: str) -> DataFrame:
        own = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"))
        return raw_lines(spark, d).join(own, "id", "left_semi")

    return rows


_OK_IP = "CASE WHEN u % 300 <= 255 THEN ip END"


@query("n03_classify", f"WITH {EV} SELECT raw_id, CASE WHEN sourcetype = 'wazuh-alerts' THEN 'wazuh' WHEN sourcetype = 'WinEventLog' THEN 'windows' WHEN sourcetype = 'opnsense:syslog' THEN 'opnsense' ELSE 'juiceshop' END AS vendor, CASE WHEN sourcetype = 'wazuh-alerts' THEN 'alert' WHEN sourcetype = 'WinEventLog' THEN 'event' WHEN sourcetype = 'opnsense:syslog' THEN 'network' ELSE 'web' END AS kind FROM ev")
def n03(spark: SparkSession, d: str) -> DataFrame:
    c = N.classify(F.col("sourcetype"), F.col("source"))
    return normalized_events(spark, d).select("raw_id", c["vendor"].alias("vendor"), c["kind"].alias("kind"))


@query("n05_windows_message", f"WITH {RAW} SELECT event_id AS id, ip AS src_ip, CASE WHEN k % 5 = 0 THEN 'FAIL_LAB_BURST_' ELSE 'user_' END || u AS username, 'Security-Auditing' AS win_source, '4625' AS code FROM raw WHERE t = 'error'")
def n05(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("raw_text")
    return lines("error")(spark, d).select("id", K.either_match(m, N.WIN_SRC).alias("src_ip"), N.windows_user(m).alias("username"), K.match(m, N.WIN_SOURCE).alias("win_source"), K.match(m, N.WIN_CODE).alias("code"))


@query("n06_xml_user", f"WITH {RAW} SELECT event_id AS id, 'user_' || u AS username, ip AS src_ip, '10.3.3.3' AS dest_ip FROM raw WHERE t = 'signup'")
def n06(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("raw_text")
    return lines("signup")(spark, d).select("id", N.xml_user(m).alias("username"), K.either_match(m, N.WIN_SRC).alias("src_ip"), K.either_match(m, N.WIN_DEST).alias("dest_ip"))


@query("n11_access_log", f"WITH {RAW} SELECT event_id AS id, ip, 'GET' AS method, '/p/' || k AS path, CASE WHEN k % 10 = 0 THEN 500 ELSE 200 END AS status FROM raw WHERE t = 'click'")
def n11(spark: SparkSession, d: str) -> DataFrame:
    part = lambda g: K.match(F.col("raw_text"), N.ACCESS_LOG, g)
    return lines("click")(spark, d).select("id", part(1).alias("ip"), part(2).alias("method"), part(3).alias("path"), part(4).cast("int").alias("status"))


@query("n12_ipv4", f"WITH {RAW} SELECT event_id AS id, {_OK_IP} AS ip FROM raw")
def n12(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    text = F.concat(F.lit(" \t10.1."), (F.col("user_id") % 300).cast("string"), F.lit(".7\n"))
    return rows.select(F.col("event_id").alias("id"), K.ipv4(text).alias("ip"))


@query("n15_first_address", "SELECT doc_id, NULLIF(regexp_extract(text, '(\\d{1,3}(?:\\.\\d{1,3}){3})', 1), '') AS ip FROM documents")
def n15(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", K.match(F.col("text"), N.IP).alias("ip"))


@query("n17_ids_line", f"WITH {RAW} SELECT event_id AS id, '1:' || k || ':3' AS rule_id, 'ET SCAN probe ' || k AS signature, k % 3 + 1 AS priority FROM raw WHERE t = 'view' AND k % 2 = 1")
def n17(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("raw_text")
    rows = lines("view")(spark, d).where(p.contains("suricata"))
    return rows.select("id", K.match(p, N.IDS_ID).alias("rule_id"), K.match(p, N.IDS_TEXT).alias("signature"), K.match(p, N.IDS_PRIORITY).cast("int").alias("priority"))


@query("n21_severity", f"WITH {EV} SELECT raw_id, CASE raw_id % 9 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 12 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 4 END AS severity FROM ev")
def n21(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, [" Error", "CRITICAL", "warning", "low", "debug", " 12 ", "7.5", "", "Medium"]))
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select(F.col("event_id").alias("raw_id"), N.canonical_severity(F.get(words, (F.col("event_id") % 9).cast("int"))).alias("severity"))


query("n24_rule_digest", f"WITH {EV} SELECT raw_id, substr(md5(signature), 1, 8) AS rule_id FROM ev")(lambda s, d: normalized_events(s, d).select("raw_id", N.short_digest(F.col("signature")).alias("rule_id")))

_HOST = "CASE WHEN host = 'unknown' AND t IN ('click', 'purchase') THEN 'unknown' ELSE host END"
NORMALIZED = f"""x AS (SELECT event_id AS raw_id, t, host,
  CASE t WHEN 'click' THEN 'juiceshop' WHEN 'purchase' THEN 'juiceshop' WHEN 'view' THEN 'opnsense' WHEN 'error' THEN 'wazuh' ELSE 'windows' END AS v0,
  CASE t WHEN 'click' THEN 'web' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'alert' ELSE 'web' END WHEN 'view' THEN CASE WHEN k % 2 = 1 THEN CASE WHEN k % 3 < 2 THEN 'alert' ELSE 'ids' END ELSE CASE WHEN k % 4 = 0 THEN 'alert' ELSE 'network' END END
    WHEN 'error' THEN 'alert' ELSE 'auth' END AS kind,
  CASE WHEN t <> 'purchase' THEN {_OK_IP} END AS src_ip,
  CASE WHEN t = 'view' AND k % 2 = 0 THEN '10.2.2.2' WHEN t = 'signup' THEN '10.3.3.3' END AS dest_ip,
  CASE t WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 'FAIL_LAB_BURST_' ELSE 'user_' END || u WHEN 'signup' THEN 'user_' || u END AS username,
  CASE t WHEN 'error' THEN '4625' WHEN 'signup' THEN '4624' WHEN 'view' THEN CASE WHEN k % 2 = 1 THEN '1:' || k || ':3' ELSE 'flow:dns' END END AS rule,
  CASE t WHEN 'click' THEN NULL WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN substr('error: order ' || k || ' of user ' || u || ' could not be placed, try it again', 1, 50) || CASE WHEN length('error: order ' || k || ' of user ' || u || ' could not be placed, try it again') > 50 THEN '..' ELSE '' END ELSE 'info: order ' || k END
    WHEN 'view' THEN CASE WHEN k % 2 = 1 THEN 'ET SCAN probe ' || k ELSE 'zenarmor:' || CASE WHEN k % 4 = 0 THEN 'blocked' ELSE 'allowed' END || ':dns:out' END WHEN 'error' THEN 'EventCode=4625' ELSE 'EventCode=4624' END AS sig,
  CASE t WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 7 ELSE 0 END WHEN 'view' THEN CASE WHEN k % 2 = 1 THEN CASE k % 3 WHEN 0 THEN 7 WHEN 1 THEN 4 ELSE 1 END ELSE CASE WHEN k % 4 = 0 THEN 4 ELSE 0 END END
    WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 7 ELSE 2 END ELSE 0 END AS sev,
  CASE WHEN t = 'click' THEN 'GET' END AS http_method, CASE WHEN t = 'click' THEN '/p/' || k END AS http_path, CASE WHEN t = 'click' THEN CASE WHEN k % 10 = 0 THEN 500 ELSE 200 END END AS http_status
 FROM raw),
 norm AS (SELECT raw_id, CASE WHEN host LIKE '%8088%' THEN 'infra' WHEN v0 = 'windows' THEN 'sysmon' ELSE v0 END AS vendor, CASE WHEN host LIKE '%8088%' THEN 'metric' ELSE kind END AS event_kind, host, src_ip, dest_ip, username,
  COALESCE(rule, substr(md5(CASE WHEN host LIKE '%8088%' THEN 'pipeline_noise' ELSE COALESCE(sig, v0 || ':web') END), 1, 8)) AS rule_id,
  CASE WHEN host LIKE '%8088%' THEN 'pipeline_noise' ELSE COALESCE(sig, http_method || ' ' || http_path) END AS signature,
  CASE WHEN host LIKE '%8088%' THEN 0 ELSE sev END AS severity, http_method, http_path, http_status FROM x)"""
query("n_normalized", f"WITH {RAW}, {NORMALIZED} SELECT * FROM norm")(lambda s, d: N.normalize(raw_lines(s, d)).drop("event_time", "source", "sourcetype"))


# Rules that the lines above don't reach: a payload or line is built for each.


def _text(*xs):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])


def parsed(spark: SparkSession, d: str, sourcetype: str, payload, line="nothing to see", host="h", function=N.normalize) -> DataFrame:
    """Normalized events of one raw row an event; k and u are columns of payload, line and host."""
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("k", _k()).withColumn("u", F.col("user_id"))
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    raw = rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("event_time"), F.lit(sourcetype).alias("sourcetype"), F.lit("s").alias("source"), as_column(host).alias("host"), as_column(payload).alias("raw_json"), as_column(line).alias("raw_text"))
    return function(raw)


@query("n07_level_names", f"WITH {RAW} SELECT event_id AS raw_id, CAST(CASE k % 5 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS severity FROM raw")
def n07(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*map(F.lit, ['{"Type":"Error"}', '{"Type":"","Level":"Critical"}', '{"LevelDisplayName":["Warning","x"]}', '{"Type":"Information"}', '{"Type":"Verbose"}']))
    return parsed(spark, d, "WinEventLog", F.get(forms, F.col("k") % 5)).select("raw_id", "severity")


@query("n08_rule_object", f"WITH {RAW} SELECT event_id AS raw_id, CASE WHEN k % 2 = 0 THEN 'alert' ELSE 'event' END AS event_kind, 'rule ' || k AS signature, '57' || k AS rule_id, CAST(CASE WHEN u % 16 >= 12 THEN 7 WHEN u % 16 >= 7 THEN 4 WHEN u % 16 = 0 THEN 0 ELSE 1 END AS INTEGER) AS severity FROM raw")
def n08(spark: SparkSession, d: str) -> DataFrame:
    groups = F.when(F.col("k") % 2 == 0, '["sshd","authentication_failed"]').otherwise('["sshd"]')
    payload = _text('{"rule":{"level":', F.col("u") % 16, ',"id":"57', F.col("k"), '","description":"rule ', F.col("k"), '","groups":', groups, "}}")
    return parsed(spark, d, "WinEventLog", payload).select("raw_id", "event_kind", "signature", "rule_id", "severity")


@query("n13_web_fallbacks", f"WITH {RAW} SELECT event_id AS raw_id, CASE k % 4 WHEN 0 THEN 'dev1' WHEN 1 THEN 'shop_' || k WHEN 2 THEN 'juiceshop' ELSE 'own' END AS host, CASE WHEN k % 4 = 0 THEN {_OK_IP} END AS src_ip FROM raw")
def n13(spark: SparkSession, d: str) -> DataFrame:
    payload = F.when(F.col("k") % 4 == 0, _text('{"clientip":"10.1.', F.col("u") % 300, '.7","dvc":"dev1"}')).when(F.col("k") % 4 == 1, _text('{"container_name":"shop_', F.col("k"), '"}')).when(F.col("k") % 4 == 2, "{}").otherwise('{"dvc":"x"}')
    host = F.when(F.col("k") % 4 == 3, "own").when(F.col("k") % 4 == 1, "").otherwise("unknown")
    return parsed(spark, d, "juiceshop:app", payload, host=host).select("raw_id", "host", "src_ip")


@query("n16_json_alert", f"WITH {RAW} SELECT event_id AS raw_id, 'ids' AS event_kind, 'ET probe ' || k AS signature, CAST(k AS VARCHAR) AS rule_id, CASE WHEN k % 3 > 0 THEN {_OK_IP} END AS src_ip, '10.5.5.5' AS dest_ip FROM raw")
def n16(spark: SparkSession, d: str) -> DataFrame:
    address = F.when(F.col("k") % 3 > 0, _text('"src_ip":"10.1.', F.col("u") % 300, '.7",')).otherwise("")
    payload = _text('{"alert":{"signature":"ET probe ', F.col("k"), '","signature_id":', F.col("k"), "},", address, '"dest_ip":"10.5.5.5"}')
    return parsed(spark, d, "suricata", payload, "from 9.9.9.9").select("raw_id", "event_kind", "signature", "rule_id", "src_ip", "dest_ip")


@query("n19_action_line", f"WITH {RAW} SELECT event_id AS raw_id, 'network' AS event_kind, 'allowed firmware.reload.' || k AS signature, 'firmware.reload.' || k AS rule_id, {_OK_IP} AS src_ip FROM raw")
def n19(spark: SparkSession, d: str) -> DataFrame:
    line = _text("configd 10.1.", F.col("u") % 300, ".7 action allowed firmware.reload.", F.col("k"), " for user root")
    return parsed(spark, d, "opnsense:syslog", "{}", line).select("raw_id", "event_kind", "signature", "rule_id", "src_ip")


@query("n20_event_type", f"WITH {RAW} SELECT event_id AS raw_id, 'dns' || (k % 3) AS signature, substr(md5('dns' || (k % 3)), 1, 8) AS rule_id FROM raw")
def n20(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, "opnsense", _text('{"event_type":"dns', F.col("k") % 3, '"}')).select("raw_id", "signature", "rule_id")


@query("n28_quarantine", f"WITH {RAW} SELECT event_id AS raw_id, CASE WHEN k % 4 = 0 THEN 'broken payload' ELSE 'metric line' END AS reason FROM raw WHERE k % 4 < 2")
def n28(spark: SparkSession, d: str) -> DataFrame:
    payload = F.when(F.col("k") % 4 == 0, _text('{"k":', F.col("k"))).otherwise("{}")
    return parsed(spark, d, "opnsense", payload, F.when(F.col("k") % 4 == 1, "1.00      2.00").otherwise("x"), function=N.rejected)


@query("n02_kept_payloads", f"WITH {RAW} SELECT event_id AS raw_id, 'windows' AS vendor, CASE WHEN k % 4 = 1 THEN 'auth' ELSE 'event' END AS event_kind, CASE k % 4 WHEN 1 THEN '4624' ELSE '77' || (k % 5) END AS rule_id, CASE WHEN k % 4 = 1 THEN 'u' ELSE 'text ' || k END AS username FROM raw")
def n02(spark: SparkSession, d: str) -> DataFrame:
    """Broken payloads, read from their raw text, lists, and payloads that repeat keys."""
    k = F.col("k")
    payload = F.when(k % 4 == 0, _text('{"EventCode":"9', k)).when(k % 4 == 1, '{"EventCode":"1","Message":"x","EventCode":"4624","Message":"User: u"}').when(k % 4 == 2, "[1, 2]").otherwise("{}")
    return parsed(spark, d, "WinEventLog", payload, _text("EventCode=77", k % 5, " User: text ", k)).select("raw_id", "vendor", "event_kind", "rule_id", "username")


@query("n30_inner_json", f"WITH {RAW} SELECT event_id AS id, k AS inner FROM raw")
def n30(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("k", _k())
    v = F.parse_json(_text('{"_raw":"{\\"a\\":{\\"b\\":', F.col("k"), '}}"}'))
    return rows.select(F.col("event_id").alias("id"), F.try_variant_get(N.inner_json(v, "$.a.b"), "$", "int").alias("inner"))


@query("n01_n27_rejected", "SELECT event_id AS raw_id, CASE WHEN event_id % 6 = 0 THEN 'metric line' ELSE 'no time' END AS reason FROM events WHERE event_id % 6 = 0 OR event_id % 5 = 0")
def n01(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = raw_lines(spark, d).withColumn("raw_text", F.when(i % 6 == 0, "0.00      1.00").otherwise(F.col("raw_text"))).withColumn("event_time", F.when(i % 5 != 0, F.col("event_time")))
    return N.rejected(rows)


query("n26_extras", "SELECT event_id AS id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.explode(N.extras(F.concat(F.lit('{"_raw":"x","_cd":"1","Message":"m",'), F.substring("props", 2, 1000)))))
)
query("n29_key_values", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user, event_type AS kind FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet")
    .select(F.col("event_id").alias("id"), N.key_values(F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit("\r\nno pair\nkind = "), F.col("event_type"))).alias("m"))
    .select("id", F.col("m")["user"].alias("user"), F.col("m")["kind"].alias("kind"))
)

# Envelopes, keys and times


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Export lines, some without a result, some broken."""
    e, t = F.col("event_id"), F.col("event_type")
    body = F.concat(F.lit('{"_cd":'), F.when(e % 4 == 0, "null").otherwise(F.concat(F.lit('"7:'), e.cast("string"), F.lit('"'))), F.lit(',"_time":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(' UTC","sourcetype":"'), t, F.lit('","source":"s","host":"h'), (F.col("user_id") % 3).cast("string"), F.lit('","_raw":"raw '), e.cast("string"), F.lit('","agent.name":"a"}'))
    line = F.when(e % 10 == 9, "not json").when(e % 10 == 8, '{"preview":true}').otherwise(F.concat(F.lit('{"preview":false,"result":'), body, F.lit("}")))
    return spark.read.parquet(f"{d}/events.parquet").select(line.alias("value"))


_BASE = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' UTC'"
_ENV = f"""env AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'hash:' || sha256({_BASE} || '|' || event_type || '|s|h' || (user_id % 3) || '|raw ' || event_id) ELSE 'splunk:7:' || event_id END AS event_key,
  date_trunc('millisecond', ts) AS event_time, event_type AS sourcetype, 's' AS source, 'h' || (user_id % 3) AS host, 'a' AS agent_name, 'raw ' || event_id AS raw_text, event_id FROM events WHERE event_id % 10 < 8)"""
def _told(events: DataFrame, prefix: str = "$") -> DataFrame:
    return events.select(*[F.get_json_object("event", f"{prefix}.{x}").alias(x.strip("_")) for x in ("_cd", "sourcetype", "host", "_raw")])


_TOLD = "CASE WHEN event_id % 4 > 0 THEN '7:' || event_id END AS cd, event_type AS sourcetype, 'h' || (user_id % 3) AS host, 'raw ' || event_id AS raw"
query("s01_export_events", f"SELECT {_TOLD} FROM events WHERE event_id % 10 < 8")(lambda s, d: _told(I.export_events(exported(s, d))))
query("s04_export_lenient", f"SELECT {_TOLD}, false AS preview FROM events WHERE event_id % 10 < 8 UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 10 = 8")(
    lambda s, d: _told(I.export_events(exported(s, d), unwrap=False).select("event"), "$.result").withColumn("preview", F.col("raw").isNull())
)
query("s08_s09_envelope", f"WITH {_ENV} SELECT * EXCLUDE (event_id) FROM env")(
    lambda s, d: I.envelope(I.export_events(exported(s, d))).withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).select("event_key", "event_time", "sourcetype", "source", "host", "agent_name", "raw_text")
)
query("s10_backfill_key", f"WITH {EV} SELECT raw_id, CASE WHEN raw_id % 4 = 0 THEN 'cd' || raw_id ELSE md5(sourcetype || '|' || source || '|' || host || '|') END AS event_key FROM ev")(
    lambda s, d: normalized_events(s, d).select("raw_id", K.backfill_key(F.when(F.col("raw_id") % 4 == 0, F.concat(F.lit("cd"), F.col("raw_id").cast("string"))), F.col("sourcetype"), F.col("source"), F.col("host"), F.lit(None).cast("string")).alias("event_key"))
)
query("s11_append_raw", f"WITH {_ENV} SELECT event_key FROM env WHERE sourcetype <> 'click'")(
    lambda s, d: S.append_new(I.envelope(I.export_events(exported(s, d))).where("sourcetype = 'click'").select("event_key"), I.envelope(I.export_events(exported(s, d).union(exported(s, d)))).select("event_key", "event_time"), ["event_key"], ["event_time"]).select("event_key")
)


@query("s16_event_times", "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('millisecond', ts) WHEN 4 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 5 THEN date_trunc('second', ts) END AS at FROM events")
def s16(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts")
    f = lambda p: F.date_format(at, p)
    forms = [F.unix_timestamp(at.cast("timestamp")).cast("string"), F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), F.concat(f("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC")), F.concat(f("yyyy-MM-dd HH:mm:ss"), F.lit(" SAST")), F.concat(F.lit(" "), f("yyyy-MM-dd HH:mm:ss"), F.lit("\n")), F.lit("yesterday")]
    text = F.get(F.array(*forms), (F.col("event_id") % 7).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), K.event_time(text).cast("timestamp_ntz").alias("at"))


_FILES = """files AS (SELECT 'f' || (event_id // 20) AS path, event_id, user_id, (event_id // 20) % 6 AS shape, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) AS n FROM events)"""


@query("s06_s07_files", f"WITH {_FILES} SELECT path, event_id, CAST(user_id AS BIGINT) AS user_id, TIMESTAMP '2024-01-01 00:00:00' AS event_time FROM files WHERE shape < 4 OR shape = 4 AND n = 1 OR shape = 5 AND event_id % 3 > 0")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Events in files of twenty, of every shape, with their times set to one instant: arrays, wrapped arrays, one wrapped event, lines with broken ones."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.floor(F.col("event_id") / 20).alias("f"))
    one = _text('{"id":', F.col("event_id"), ',"u":', F.col("user_id"), ',"_time":"1"}')
    line = F.when(F.col("event_id") % 3 == 0, _text("{broken ", F.col("event_id"))).when(F.col("event_id") % 3 == 1, _text('{"result":', one, "}")).otherwise(one)
    listed = rows.groupBy("f").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("event_id", x.alias("x")))), lambda y: y["x"]).alias(n) for n, x in (("e", one), ("l", line))])
    joined = F.array_join("e", ",\n")
    shape = F.col("f") % 6
    value = F.when(shape == 0, _text("[", joined, "]")).when(shape == 1, _text('{"results":[', joined, "]}")).when(shape == 2, _text("\ufeff[", joined, "]")).when(shape == 3, F.array_join("e", "\n")).when(shape == 4, _text('{"result":', F.get("e", F.lit(0)), "}")).otherwise(F.array_join("l", "\n\n"))
    events = I.retimed(I.parse_files(listed.select(_text("f", F.col("f")).alias("path"), value.alias("value"))), F.lit(datetime(2024, 1, 1)))
    at = K.event_time(F.get_json_object("event", "$._time")).cast("timestamp_ntz")
    return events.select("path", F.get_json_object("event", "$.id").cast("bigint").alias("event_id"), F.get_json_object("event", "$.u").cast("bigint").alias("user_id"), at.alias("event_time"))
