"""Queries of the feature, detection, correlation, serving and table-state operators, with their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigloom.operators import correlate as C, detect as D, features as X, serve as V, state as S
from sigloom.operators.keyed import Profiles
from sigloom.operators.textindex import TextIndex
from sigloom.params import Compat
from sigloom.plans import batch as B
from sigloom.sources.adapter import EV, normalized_events
from sigloom.storage import stored, work_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SUSPECT = "(COALESCE(severity,0) >= 5 OR COALESCE(http_status,0) >= 400 OR " + " OR ".join(f"signature ILIKE '%{s}%'" for s in X.SUSPICIOUS) + ")"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _minute(name: str, index: int, vendor: str, kind: str, entity: str, where: str, second: str | None = None, second_type: str = "-") -> str:
    two = f"COALESCE({second}, 'unknown')" if second else "'-'"
    seen = f"'{vendor}'" if vendor else "string_agg(DISTINCT vendor, ',' ORDER BY vendor)"
    return f"""SELECT time_bucket(INTERVAL '60 seconds', event_time) AS bin_start, CAST(60 AS INTEGER) AS bin_size_sec, {seen} AS vendor, '{name}' AS feature_name,
 '{kind}' AS entity_type, COALESCE({entity}, 'unknown') AS entity_id, '{second_type}' AS secondary_type, {two} AS secondary_id,
 CAST(count(*) AS DOUBLE) AS value, CAST(count(*) AS INTEGER) AS n_events FROM ev WHERE {where} GROUP BY 1, 6, 8"""


MINUTE_SQL = [
    _minute("auth_fail_count", 0, "wazuh", "host", "host", "rule_id = '4625'"),
    _minute("auth_success_count", 1, "wazuh", "host", "host", "rule_id = '4624'"),
    _minute("auth_fail_count", 2, "wazuh", "user", "username", "rule_id = '4625' AND username IS NOT NULL"),
    _minute("src_ip_fail_count", 3, "wazuh", "host", "host", "rule_id = '4625' AND src_ip IS NOT NULL", "src_ip", "src_ip"),
    _minute("wazuh_alert_count", 4, "wazuh", "host", "host", "vendor = 'wazuh'"),
    _minute("juiceshop_error_count", 5, "juiceshop", "endpoint", "http_path", "vendor = 'juiceshop' AND (http_status >= 400 OR event_kind = 'alert')"),
    _minute("bad_event_count", 6, "", "host", "host", SUSPECT),
    _minute("zenarmor_allowed_count", 7, "", "host", "host", "vendor = 'opnsense' AND signature ILIKE '%allowed%'"),
    _minute("signature_count", 8, "", "host", "host", "signature IS NOT NULL", "signature", "signature"),
    _minute("src_ip_count", 9, "", "host", "host", "src_ip IS NOT NULL", "src_ip", "src_ip"),
]
FT = "ft AS (" + "\nUNION ALL ".join(MINUTE_SQL) + ")"
_NAMES = ["f01_auth_fail_host", "f02_auth_success_host", "f03_auth_fail_user", "f04_src_ip_fail", "f05_wazuh_alerts", "f06_juiceshop_errors", "f07_bad_events", "f08_zenarmor_allowed", "f09_signatures", "f10_src_ips"]


def _one(i: int):
    return lambda spark, d: X.minute_rollup(normalized_events(spark, d), features=[X.minute_features()[i]])


for _i, _n in enumerate(_NAMES):
    query(_n, f"WITH {EV} {MINUTE_SQL[_i]}")(_one(_i))


def features(spark: SparkSession, d: str) -> DataFrame:
    return X.minute_rollup(normalized_events(spark, d))


query("f11_minute_features", f"WITH {EV}, {FT} SELECT * FROM ft")(features)


@query("f11_lookback_window", f"WITH {EV}, {FT} SELECT * FROM ft WHERE bin_start >= TIMESTAMP '2024-01-15 11:00:00' ")
def f11_lookback(spark: SparkSession, d: str) -> DataFrame:
    return X.minute_rollup(normalized_events(spark, d), as_of=F.lit(datetime(2024, 1, 15, 12, 0, 30)), lookback_minutes=60)


@query("f11_upsert", f"WITH {EV}, {FT} SELECT bin_start, feature_name, entity_type, entity_id, secondary_id, value FROM ft")
def f11_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).select("bin_start", "feature_name", "entity_type", "entity_id", "secondary_id", "value")
    stale = rows.where("hour(bin_start) < 12").withColumn("value", F.lit(-1.0))
    return S.upserted(stale, rows, ["bin_start", "feature_name", "entity_type", "entity_id", "secondary_id"])


query("f12_entity_stats", f"WITH {EV}, {FT} SELECT entity_type, entity_id, min(bin_start) AS first_seen, max(bin_start) AS last_seen, CAST(sum(n_events) AS BIGINT) AS event_count FROM ft GROUP BY 1, 2")(lambda s, d: X.entity_stats(features(s, d)))
_QUIET = " AND ".join(f"secondary_id NOT ILIKE '%{w}%'" for w in X.PROFILE_NOISE)
_TOP = """WITH {ev}, {ft}, n AS (SELECT entity_type, entity_id, secondary_id, CAST(sum(value) AS BIGINT) AS c FROM ft WHERE feature_name = 'signature_count' AND {quiet} GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY c DESC, secondary_id) AS rn FROM n)
 SELECT entity_type, entity_id, '[' || string_agg('{{"sig":"' || secondary_id || '","count":' || c || '}}', ',' ORDER BY rn) || ']' AS top_signatures FROM r WHERE rn <= {n} GROUP BY 1, 2"""
query("f13_top_signatures", _TOP.format(ev=EV, ft=FT, quiet=_QUIET, n=1000000))(lambda s, d: X.top_signatures(features(s, d)))
query("f13_top_signatures_3", _TOP.format(ev=EV, ft=FT, quiet=_QUIET, n=3))(lambda s, d: X.top_signatures(features(s, d), Compat(top_n=3)))
query("f14_unique_src_ips", f"WITH {EV}, {FT} SELECT entity_type, entity_id, count(DISTINCT secondary_id) AS unique_src_ips FROM ft WHERE feature_name = 'src_ip_count' GROUP BY 1, 2")(lambda s, d: X.unique_src_ips(features(s, d)))



@query("f12_f14_incremental", _TOP.format(ev=EV, ft=FT, quiet=_QUIET, n=1000000).replace(" SELECT entity_type, entity_id, '['", ", top AS (SELECT entity_type, entity_id, '['") + f"""),
 ips AS (SELECT entity_type, entity_id, count(DISTINCT secondary_id) AS unique_src_ips FROM ft WHERE feature_name = 'src_ip_count' GROUP BY 1, 2),
 st AS (SELECT entity_type, entity_id, min(bin_start) AS first_seen, max(bin_start) AS last_seen, CAST(sum(n_events) AS BIGINT) AS event_count FROM ft GROUP BY 1, 2)
 SELECT st.*, unique_src_ips, top_signatures FROM st LEFT JOIN ips ON ips.entity_type = st.entity_type AND ips.entity_id = st.entity_id LEFT JOIN top ON top.entity_type = st.entity_type AND top.entity_id = st.entity_id""")
def f12_increments(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of three increments, the second of them added twice."""
    rows = stored(features(spark, d), "features")
    kept = Profiles(spark, work_path(spark, "profiles"), parts=16, buckets=4, time="timestamp_ntz")
    for day in (10, 20, 20, 99):
        upto = F.lit(datetime(2024, 1, min(day, 31))) if day < 99 else None
        after = F.lit(datetime(2024, 1, 10 if day == 20 else 20)) if day > 10 else None
        part = rows if upto is None else rows.where(F.col("bin_start") < upto)
        kept.add(part if after is None else part.where(F.col("bin_start") >= after), str(day))
    return kept.profiles()


_BIN = "time_bucket(INTERVAL '300 seconds', event_time) AS bin_start, CAST(300 AS INTEGER) AS bin_size_sec"


def _five(metric: str, kind: str, entity: str, value: str = "CAST(count(*) AS DOUBLE)", meta: str = "CAST(NULL AS VARCHAR)", where: str = "true") -> str:
    return f"SELECT {_BIN}, '{metric}' AS feature_name, '{kind}' AS entity_type, {entity} AS entity_id, {value} AS value, CAST(count(*) AS INTEGER) AS n_events, {meta} AS meta FROM ev WHERE {where} GROUP BY 1, {entity}"


_none = "COALESCE(NULLIF({}, ''), '(none)')".format
_FAIL = "CAST(sum(CASE WHEN sourcetype = 'wazuh-alerts' AND (" + " OR ".join(f"lower(signature) LIKE '%{p}%'" for p in X.AUTH_PHRASES) + ") THEN 1 ELSE 0 END) AS DOUBLE)"
_ERR = "sum(CASE WHEN http_status >= 400 THEN 1 ELSE 0 END)"
G = {
    "g01_host_events": _five("event_count", "host", _none("host")),
    "g02_signature_events": _five("event_count", "signature", "signature", meta="'{\"sourcetype\":[' || string_agg(DISTINCT '\"' || sourcetype || '\"', ',' ORDER BY '\"' || sourcetype || '\"') || ']}'", where="signature <> ''"),
    "g03_rule_events": _five("event_count", "rule_id", _none("rule_id"), where="sourcetype = 'wazuh-alerts'"),
    "g04_auth_failures": _five("auth_fail_count", "host", _none("host"), _FAIL) + " UNION ALL " + _five("auth_fail_count", "user", _none("username"), _FAIL),
    "g06_error_rates": _five("error_rate", "endpoint", _none("http_path"), f"CAST({_ERR} AS DOUBLE) / count(*)", f"'{{\"total\":' || count(*) || ',\"errors\":' || {_ERR} || '}}'", "sourcetype = 'juiceshop:app'"),
}
for _n, _f in (("g01_host_events", X.host_counts), ("g02_signature_events", X.signature_counts), ("g03_rule_events", X.rule_counts), ("g04_auth_failures", X.auth_failures), ("g06_error_rates", X.error_rates)):
    query(_n, f"WITH {EV} {G[_n]}")(lambda s, d, f=_f: f(normalized_events(s, d)))
_RANKED = f"""WITH {EV}, n AS (SELECT time_bucket(INTERVAL '300 seconds', event_time) AS bin_start, {_none('host')} AS host, src_ip, count(*) AS c FROM ev WHERE src_ip IS NOT NULL GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY bin_start, host ORDER BY c DESC, src_ip) AS rn FROM n)"""
query("g05_top_src_ips", _RANKED + " SELECT bin_start, host, src_ip, c AS count, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 5")(lambda s, d: X.top_src_ips(normalized_events(s, d)))
_TOP_IPS = """SELECT bin_start, CAST(300 AS INTEGER) AS bin_size_sec, 'top_src_ip' AS feature_name, 'host' AS entity_type, host AS entity_id, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS INTEGER) AS n_events,
 '{"top":[' || string_agg('{"src_ip":"' || src_ip || '","count":' || c || '}', ',' ORDER BY rn) || ']}' AS meta FROM r WHERE rn <= 5 GROUP BY bin_start, host"""
query("g05_top_src_ip_json", _RANKED + " " + _TOP_IPS)(lambda s, d: X.top_src_ip_json(normalized_events(s, d)))
query("g08_five_minute_rollup", _RANKED + " " + " UNION ALL ".join([*G.values(), _TOP_IPS]))(lambda s, d: X.five_minute_rollup(normalized_events(s, d)))
query("g07_host_profiles", f"""WITH {EV} SELECT 'host' AS entity_type, {_none('host')} AS entity_id, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS event_count,
 count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT username) FILTER (WHERE username <> '') AS unique_users FROM ev GROUP BY 2""")(lambda s, d: X.host_profiles(normalized_events(s, d)))

# Detections.  The events are sparse, so windows and thresholds are wider than the defaults.

DAY, WEEK = timedelta(hours=24), timedelta(days=6)
_NOW = "now_ AS (SELECT max(bin_start) AS now FROM {0})"
query("d01_feature_clock", f"WITH {EV}, {FT} SELECT max(bin_start) AS now FROM ft")(lambda s, d: features(s, d).agg(F.max("bin_start").alias("now")))


@query("d02_auth_fail_spike", f"""WITH {EV}, {FT}, {_NOW.format('ft')},
 cur AS (SELECT entity_id, sum(value) AS c FROM ft, now_ WHERE feature_name = 'auth_fail_count' AND entity_type = 'host' AND bin_start > now - INTERVAL 24 HOUR GROUP BY 1),
 base AS (SELECT entity_id, avg(value) AS a FROM ft, now_ WHERE feature_name = 'auth_fail_count' AND entity_type = 'host' AND bin_start > now - INTERVAL 168 HOUR AND bin_start <= now - INTERVAL 24 HOUR GROUP BY 1)
 SELECT now AS event_time, now - INTERVAL 24 HOUR AS window_start, now AS window_end, 'auth_fail_spike' AS signal_name, 'host' AS entity_type, cur.entity_id, CAST(7 AS INTEGER) AS severity,
  round(c / (COALESCE(a, 0) + 0.1), 9) AS score, 'auth_fail_spike|host|' || cur.entity_id || '|' || strftime(now, '%Y%m%d%H%M%S') AS dedupe_key,
  round(c, 6) AS of_now, round(COALESCE(a, 0), 6) AS of_base
 FROM cur LEFT JOIN base ON cur.entity_id = base.entity_id, now_ WHERE c >= 5 AND c > COALESCE(a, 0) * 3 + 5""")
def d02(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    return X_round(D.auth_fail_spikes(f, D.feature_clock(f), DAY, WEEK), "current_sum", "baseline_avg")


def X_round(signals: DataFrame, now: str, base: str) -> DataFrame:
    """The score and the two numbers of the metadata, rounded."""
    of = lambda name: F.round(F.get_json_object("metadata", f"$.{name}").cast("double"), 6)
    return signals.withColumns({"score": F.round("score", 9), "of_now": of(now), "of_base": of(base)}).drop("metadata")


@query("d03_silent_agents", f"""WITH {EV}, g AS ({_five('event_count', 'user', 'username')}), {_NOW.format('g')}
 SELECT now AS event_time, now - INTERVAL 24 HOUR AS window_start, now AS window_end, 'agent_silent' AS signal_name, 'user' AS entity_type, entity_id, CAST(3 AS INTEGER) AS severity, CAST(10 AS DOUBLE) AS score,
  'agent_silent|user|' || entity_id || '|' || strftime(now, '%Y%m%d%H%M%S') AS dedupe_key, '{{}}' AS metadata
 FROM g, now_ WHERE bin_start > now - INTERVAL 168 HOUR GROUP BY now, entity_id HAVING max(bin_start) <= now - INTERVAL 24 HOUR""")
def d03(spark: SparkSession, d: str) -> DataFrame:
    f = X._metric(normalized_events(spark, d), "user", "event_count", F.col("username"), F.count("*"))
    return D.silent_agents(f, D.feature_clock(f, 300), DAY, timedelta(days=7), 300, "user")


@query("d03_silent_hosts", f"""WITH {EV}, g AS (SELECT time_bucket(INTERVAL '60 seconds', event_time) AS bin_start, host || '-' || (raw_id % 97) AS entity_id FROM ev), {_NOW.format('g')}
 SELECT now AS event_time, now - INTERVAL 1 HOUR AS window_start, now AS window_end, 'agent_silent' AS signal_name, 'host' AS entity_type, entity_id, CAST(3 AS INTEGER) AS severity, CAST(10 AS DOUBLE) AS score,
  'agent_silent|host|' || entity_id || '|' || strftime(now, '%Y%m%d%H%M%S') AS dedupe_key, '{{}}' AS metadata
 FROM g, now_ WHERE bin_start > now - INTERVAL 24 HOUR GROUP BY now, entity_id HAVING max(bin_start) <= now - INTERVAL 1 HOUR""")
def d03_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The default windows, bins and entities, over more hosts than the events name."""
    named = normalized_events(spark, d).withColumn("host", F.concat("host", F.lit("-"), (F.col("raw_id") % 97).cast("string")))
    f = X.host_counts(named, 60)
    return D.silent_agents(f, D.feature_clock(f))


def _d04_sql(now: int, base: int, factor: float) -> str:
    return f"""WITH {EV}, g AS ({G['g06_error_rates']}), {_NOW.format('g')},
 cur AS (SELECT entity_id, avg(value) AS c FROM g, now_ WHERE bin_start > now - INTERVAL {now} HOUR GROUP BY 1),
 base AS (SELECT entity_id, avg(value) AS b FROM g, now_ WHERE bin_start > now - INTERVAL {now + base} HOUR AND bin_start <= now - INTERVAL {now} HOUR GROUP BY 1)
 SELECT now AS event_time, now - INTERVAL {now} HOUR AS window_start, now AS window_end, 'app_error_spike' AS signal_name, 'application' AS entity_type, cur.entity_id, CAST(5 AS INTEGER) AS severity,
  round(c / (COALESCE(b, 0) + 0.01), 9) AS score, 'app_error_spike|application|' || cur.entity_id || '|' || strftime(now, '%Y%m%d%H%M%S') AS dedupe_key, round(c, 6) AS of_now, round(COALESCE(b, 0), 6) AS of_base
 FROM cur LEFT JOIN base ON cur.entity_id = base.entity_id, now_ WHERE c > 0.05 AND c > COALESCE(b, 0) * {factor}"""


@query("d04_app_error_spike", _d04_sql(24, 144, 0.9))
def d04(spark: SparkSession, d: str) -> DataFrame:
    f = X.error_rates(normalized_events(spark, d))
    return X_round(D.app_error_spikes(f, D.feature_clock(f, 300), DAY, WEEK, 300, factor=0.9), "current_rate", "baseline_rate")


@query("d04_app_error_spike_default", _d04_sql(1, 6, 2))
def d04_default(spark: SparkSession, d: str) -> DataFrame:
    f = X.error_rates(normalized_events(spark, d))
    return X_round(D.app_error_spikes(f, D.feature_clock(f, 300), bin_size_sec=300), "current_rate", "baseline_rate")


_ISO = "CASE WHEN microsecond(window_end) % 1000000 = 0 THEN strftime(window_end, '%Y-%m-%dT%H:%M:%S') ELSE strftime(window_end, '%Y-%m-%dT%H:%M:%S.%f') END"
_KEY = f"sha1(signal_name || '|' || entity_type || '|' || entity_id || '|' || {_ISO} || '+00:00')"
BAD = f"""bad AS (SELECT *, {_KEY} AS dedupe_key FROM (SELECT min(bin_start) AS window_start, max(bin_start) AS window_end, 'Spike in Bad Events' AS signal_name, entity_type, entity_id, CAST(7 AS INTEGER) AS severity, sum(value) AS score,
  '{{{{"feature":"bad_event_count","threshold":{{t}},"value":' || CAST(sum(value) AS BIGINT) || '}}}}' AS metadata
 FROM ft WHERE feature_name = 'bad_event_count' GROUP BY entity_type, entity_id, {{by}} HAVING sum(value) > {{t}}))"""
RAW_ALERTS = f"""alerts AS (SELECT *, {_KEY} AS dedupe_key FROM (SELECT event_time AS window_start, event_time AS window_end, COALESCE(NULLIF(signature, ''), vendor || ' Alert') AS signal_name,
  CASE WHEN vendor = 'opnsense' AND src_ip IS NOT NULL THEN 'ip' ELSE 'host' END AS entity_type, CASE WHEN vendor = 'opnsense' AND src_ip IS NOT NULL THEN src_ip ELSE host END AS entity_id,
  CASE WHEN severity > 0 THEN severity ELSE 4 END AS severity, CAST(10 AS DOUBLE) AS score,
  '{{"rule_id":"' || rule_id || '","vendor":"' || vendor || '"' || COALESCE(',"src_ip":"' || src_ip || '"', '') || COALESCE(',"dest_ip":"' || dest_ip || '"', '') || '}}' AS metadata
 FROM ev WHERE severity >= 7 OR (vendor = 'opnsense' AND event_kind = 'ids')) WHERE entity_id <> '' AND entity_id <> 'unknown')"""
_SIG = "window_start, window_end, signal_name, entity_type, entity_id, severity, score, dedupe_key"
_WITH_META = _SIG + ", metadata"


@query("d05_bad_event_spike", f"WITH {EV}, {FT}, {BAD.format(by='true', t=50)} SELECT window_end AS event_time, {_WITH_META} FROM bad")
def d05(spark: SparkSession, d: str) -> DataFrame:
    return D.bad_event_spikes(features(spark, d))


@query("d05_bad_event_spike_daily", f"WITH {EV}, {FT}, {BAD.format(by='CAST(bin_start AS DATE)', t=10)} SELECT window_end AS event_time, {_WITH_META} FROM bad")
def d05_daily(spark: SparkSession, d: str) -> DataFrame:
    return D.bad_event_spikes(features(spark, d), threshold=10, by=[F.to_date("bin_start")])


@query("d06_promoted_alerts", f"WITH {EV}, {RAW_ALERTS} SELECT window_end AS event_time, {_WITH_META} FROM alerts")
def d06(spark: SparkSession, d: str) -> DataFrame:
    return D.promoted_alerts(normalized_events(spark, d))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Both detectors over the whole range, a signal a key."""
    return D.run_detections(features(spark, d), normalized_events(spark, d), None, None)


SIG = f"""{BAD.format(by='true', t=50)}, {RAW_ALERTS}, sig AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY window_start, score, metadata) AS n FROM
 (SELECT {_WITH_META} FROM bad UNION ALL SELECT {_WITH_META} FROM alerts)) WHERE n = 1)"""
query("d07_d08_run_detections", f"WITH {EV}, {FT}, {SIG} SELECT window_end AS event_time, {_WITH_META} FROM sig")(signals)


@query("d08_detection_window", f"WITH {EV}, {RAW_ALERTS} SELECT window_end AS event_time, {_WITH_META} FROM alerts WHERE window_end >= TIMESTAMP '2024-01-10 00:00:00' AND window_end < TIMESTAMP '2024-01-12 06:00:00'")
def d08(spark: SparkSession, d: str) -> DataFrame:
    start, end = D.window_of(datetime(2024, 1, 10), datetime(2024, 1, 12, 6, 0, 40))
    return D.promoted_alerts(normalized_events(spark, d), F.lit(start), F.lit(end))


# Incidents

FOLD = """o AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY window_end, dedupe_key) AS rn FROM sig),
 fold AS (SELECT entity_type, entity_id, rn, dedupe_key AS signal_id, dedupe_key AS incident_id, window_start AS s, window_end AS l, true AS founder FROM o WHERE rn = 1
  UNION ALL SELECT o.entity_type, o.entity_id, o.rn, o.dedupe_key,
   CASE WHEN f.l >= o.window_end - INTERVAL 30 MINUTE AND f.s >= o.window_end - INTERVAL 4 HOUR THEN f.incident_id ELSE o.dedupe_key END,
   CASE WHEN f.l >= o.window_end - INTERVAL 30 MINUTE AND f.s >= o.window_end - INTERVAL 4 HOUR THEN f.s ELSE o.window_start END,
   CASE WHEN f.l >= o.window_end - INTERVAL 30 MINUTE AND f.s >= o.window_end - INTERVAL 4 HOUR THEN greatest(f.l, o.window_end) ELSE o.window_end END,
   NOT (f.l >= o.window_end - INTERVAL 30 MINUTE AND f.s >= o.window_end - INTERVAL 4 HOUR)
  FROM fold f JOIN o ON o.entity_type = f.entity_type AND o.entity_id = f.entity_id AND o.rn = f.rn + 1),
 j AS (SELECT fold.incident_id, fold.founder, sig.* FROM fold JOIN sig ON sig.dedupe_key = fold.signal_id),
 inc AS (SELECT incident_id, max(CASE WHEN founder THEN signal_name || ' on ' || entity_id END) AS title, 'NEW' AS status, max(severity) AS severity,
  sum(CASE WHEN founder THEN score ELSE least(score, 50) END) AS score, max(entity_type) AS root_entity_type, max(entity_id) AS root_entity_id,
  max(CASE WHEN founder THEN window_start END) AS start_time, max(window_end) AS end_time, max(window_end) AS last_update_time FROM j GROUP BY 1)"""
_ALL = f"WITH RECURSIVE {EV}, {FT}, {SIG}, {FOLD}"


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """Signals with their incidents, stored: what is derived from them twice is folded once."""
    return stored(C.assign(signals(spark, d)), "signals")


query("c01_incident_assignment", _ALL + " SELECT signal_id, incident_id, founder FROM fold")(lambda s, d: assigned(s, d).select(F.col("dedupe_key").alias("signal_id"), "incident_id", "founder"))
query("c02_c03_incidents", _ALL + " SELECT * FROM inc")(lambda s, d: C.incidents(assigned(s, d)))
query("c04_evidence", _ALL + " SELECT DISTINCT incident_id, signal_id FROM fold")(lambda s, d: C.evidence(assigned(s, d)))

# All five detectors, as the job runs them.  Hosts are named more finely, so that some fall silent.

JOB = D.Baselines(current=DAY, baseline=WEEK, factor=0.9)


def job_events(spark: SparkSession, d: str) -> DataFrame:
    return normalized_events(spark, d).withColumn("host", F.concat("host", F.lit("-"), (F.col("raw_id") % 97).cast("string")))


def job_signals(spark: SparkSession, d: str) -> DataFrame:
    events = job_events(spark, d)
    return B.signals_of(stored(B.feature_table(events), "features"), events, windows=JOB)


_FINE = EV.replace("ev AS (", "ev0 AS (") + ", ev AS (SELECT * REPLACE (host || '-' || (raw_id % 97) AS host) FROM ev0)"
_EVENTS = _minute("event_count", 10, "", "host", "NULLIF(host, '')", "true").replace("'unknown'", "'(none)'")
_RATES = f"SELECT time_bucket(INTERVAL '60 seconds', event_time) AS bin_start, {_none('http_path')} AS entity_id, CAST({_ERR} AS DOUBLE) / count(*) AS value FROM ev WHERE sourcetype = 'juiceshop:app' GROUP BY 1, 2"
_BASED = f"""ec AS ({_EVENTS}), er AS ({_RATES}), now_ AS (SELECT max(bin_start) AS now FROM ec),
 b2 AS (SELECT 'auth_fail_spike' AS signal_name, 'host' AS entity_type, entity_id, 7 AS severity, c / (COALESCE(a, 0) + 0.1) AS score, INTERVAL 24 HOUR AS w FROM
   (SELECT entity_id, sum(value) FILTER (bin_start > now - INTERVAL 24 HOUR) AS c, avg(value) FILTER (bin_start <= now - INTERVAL 24 HOUR) AS a FROM ft, now_ WHERE feature_name = 'auth_fail_count' AND entity_type = 'host' AND bin_start > now - INTERVAL 168 HOUR GROUP BY 1) WHERE c >= 5 AND c > COALESCE(a, 0) * 3 + 5),
 b3 AS (SELECT 'agent_silent', 'host', entity_id, 3, 10.0, INTERVAL 1 HOUR FROM ec, now_ WHERE bin_start > now - INTERVAL 24 HOUR GROUP BY entity_id, now HAVING max(bin_start) <= now - INTERVAL 1 HOUR),
 b4 AS (SELECT 'app_error_spike', 'application', entity_id, 5, c / (COALESCE(a, 0) + 0.01), INTERVAL 24 HOUR FROM
   (SELECT entity_id, avg(value) FILTER (bin_start > now - INTERVAL 24 HOUR) AS c, avg(value) FILTER (bin_start <= now - INTERVAL 24 HOUR) AS a FROM er, now_ WHERE bin_start > now - INTERVAL 168 HOUR GROUP BY 1) WHERE c > 0.05 AND c > COALESCE(a, 0) * 0.9),
 bl AS (SELECT now - w AS window_start, now AS window_end, signal_name, entity_type, entity_id, CAST(severity AS INTEGER) AS severity, CAST(score AS DOUBLE) AS score, signal_name || '|' || entity_type || '|' || entity_id || '|' || strftime(now, '%Y%m%d%H%M%S') AS dedupe_key, '' AS metadata
  FROM (SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4), now_)"""
_ALL_SIG = SIG.replace("UNION ALL SELECT {0} FROM alerts".format(_WITH_META), "UNION ALL SELECT {0} FROM alerts UNION ALL SELECT {0} FROM bl".format(_WITH_META))
_JOB = f"WITH RECURSIVE {_FINE}, {FT}, {_BASED}, {_ALL_SIG}, {FOLD}"
query("signals_all", _JOB + " SELECT window_start, window_end, signal_name, entity_type, entity_id, severity, round(score, 6) AS score, dedupe_key FROM sig")(
    lambda s, d: job_signals(s, d).select("window_start", "window_end", "signal_name", "entity_type", "entity_id", "severity", F.round("score", 6).alias("score"), "dedupe_key")
)
query("c02_job_incidents", _JOB + " SELECT * REPLACE (round(score, 6) AS score) FROM inc")(lambda s, d: C.incidents(C.assign(job_signals(s, d))).withColumn("score", F.round("score", 6)))

# Detectors at every bin, as runs at each minute find them and as the stream does.


def swept(spark: SparkSession, d: str) -> DataFrame:
    events = job_events(spark, d)
    table = stored(B.feature_table(events), "features")
    return D.judged(D.swept(table, D.feature_clock(table), JOB), JOB)


_SWEPT = f"""WITH {_FINE}, {FT}, ec AS ({_EVENTS}), er AS ({_RATES}),
 f AS (SELECT 'auth_fail_spike' AS signal_name, 'host' AS entity_type, entity_id, bin_start, value FROM ft WHERE feature_name = 'auth_fail_count' AND entity_type = 'host' UNION ALL SELECT 'app_error_spike', 'application', entity_id, bin_start, value FROM er),
 w AS (SELECT signal_name, entity_type, entity_id, bin_start AS at_, CASE WHEN signal_name = 'app_error_spike' THEN avg(value) OVER c ELSE sum(value) OVER c END AS c, COALESCE(avg(value) OVER b, 0) AS b FROM f
  WINDOW c AS (PARTITION BY signal_name, entity_id ORDER BY bin_start RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW), b AS (PARTITION BY signal_name, entity_id ORDER BY bin_start RANGE BETWEEN INTERVAL 604799 SECOND PRECEDING AND INTERVAL 86400 SECOND PRECEDING)),
 n AS (SELECT entity_id, bin_start + INTERVAL 1 HOUR AS at_, lead(bin_start) OVER (PARTITION BY entity_id ORDER BY bin_start) AS nxt, max(bin_start) OVER () AS now FROM ec),
 s AS (SELECT signal_name, entity_type, entity_id, at_, INTERVAL 24 HOUR AS w, CASE signal_name WHEN 'auth_fail_spike' THEN 7 ELSE 5 END AS severity, c / (b + CASE signal_name WHEN 'auth_fail_spike' THEN 0.1 ELSE 0.01 END) AS score FROM w
   WHERE CASE signal_name WHEN 'auth_fail_spike' THEN c >= 5 AND c > b * 3 + 5 ELSE c > 0.05 AND c > b * 0.9 END
  UNION ALL SELECT 'agent_silent', 'host', entity_id, at_, INTERVAL 1 HOUR, 3, 10.0 FROM n WHERE COALESCE(nxt > at_, at_ <= now) AND entity_id <> '(none)')
 SELECT at_ - w AS window_start, at_ AS window_end, signal_name, entity_type, entity_id, CAST(severity AS INTEGER) AS severity, round(CAST(score AS DOUBLE), 6) AS score, signal_name || '|' || entity_type || '|' || entity_id || '|' || strftime(at_, '%Y%m%d%H%M%S') AS dedupe_key FROM s"""
query("d02_d04_at_every_bin", _SWEPT)(lambda s, d: swept(s, d).select("window_start", "window_end", "signal_name", "entity_type", "entity_id", "severity", F.round("score", 6).alias("score"), "dedupe_key"))

# Correlation in runs: three thirds of the range, the incidents of one host closed after the first.

CUTS = [datetime(2024, 1, 10), datetime(2024, 1, 20)]


def in_runs(spark: SparkSession, d: str) -> B.Tables:
    rows = stored(signals(spark, d), "signals")
    tables = B.Tables(spark, work_path(spark, "runs"))
    at = F.col("window_end")
    for i, part in enumerate((rows.where(at < CUTS[0]), rows.where((at >= CUTS[0]) & (at < CUTS[1])), rows.where(at >= CUTS[1]))):
        tables.correlate(part, f"{i}")
        if not i and tables.incidents() is not None:
            shut = stored(tables.incidents().withColumn("status", F.when(F.col("root_entity_id") == "host_1", "CLOSED").otherwise(F.col("status"))), "shut")
            B.store(shut, f"{tables.root}/incidents", "start_time")
    return tables


_CUT = "TIMESTAMP '2024-01-10 00:00:00'"
_SHUT = FOLD.replace("'NEW' AS status", f"CASE WHEN max(entity_id) = 'host_1' AND min(window_end) < {_CUT} THEN 'CLOSED' ELSE 'NEW' END AS status")
_SHUT = _SHUT.replace("f.l >= o.window_end - INTERVAL 30 MINUTE", f"(f.l >= o.window_end - INTERVAL 30 MINUTE AND NOT (o.entity_id = 'host_1' AND f.l < {_CUT} AND o.window_end >= {_CUT}))")
_RUNS = f"WITH RECURSIVE {EV}, {FT}, {SIG}, {_SHUT}"


@query("c01_incremental_incidents", _RUNS + " SELECT * FROM inc")
def c01_runs(spark: SparkSession, d: str) -> DataFrame:
    found = in_runs(spark, d).incidents()
    return C.empty_table(signals(spark, d)) if found is None else found


# Serving

_NOW_EV = "(SELECT max(event_time) FROM ev)"
_SHOWN = "strftime({} + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')".format


@query("v01_incident_list", _ALL + f", n AS (SELECT incident_id, count(*) AS c FROM (SELECT DISTINCT incident_id, signal_id FROM fold) GROUP BY 1) SELECT inc.*, CAST(COALESCE(c, 0) AS BIGINT) AS evidence_count, {_SHOWN('last_update_time')} AS last_update_str FROM inc LEFT JOIN n ON n.incident_id = inc.incident_id WHERE last_update_time >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 168 HOUR AND status = 'NEW'")
def v01(spark: SparkSession, d: str) -> DataFrame:
    a = assigned(spark, d)
    return V.incident_list(C.incidents(a), C.evidence(a), F.lit(datetime(2024, 1, 25)), 168, "NEW")


@query("v02_incident_details", _ALL + " SELECT * FROM inc WHERE incident_id = (SELECT max(incident_id) FROM inc)")
def v02(spark: SparkSession, d: str) -> DataFrame:
    inc = C.incidents(assigned(spark, d))
    return V.incident_details(inc, inc.agg(F.max("incident_id")).first()[0])


def timeline(spark: SparkSession, d: str) -> DataFrame:
    a = assigned(spark, d)
    return V.incident_evidence(a.drop("incident_id", "founder", "metadata"), C.evidence(a))


_LINE = f", tl AS (SELECT incident_id, window_end AS event_time, {_SIG}, {_SHOWN('window_end')} AS time_str FROM j)"
query("v03_evidence_timeline", _ALL + _LINE + " SELECT * FROM tl")(timeline)
query("v04_brief_stats", _ALL + _LINE + """, nm AS (SELECT incident_id, signal_name, row_number() OVER (PARTITION BY incident_id ORDER BY count(*) DESC, signal_name) AS r FROM tl GROUP BY 1, 2)
 SELECT tl.incident_id, count(*) AS total_signals, count(DISTINCT (signal_name, entity_id, window_start)) AS unique_evidence, any_value(t) AS top_types FROM tl
 JOIN (SELECT incident_id, string_agg(signal_name, ', ' ORDER BY r) AS t FROM nm WHERE r <= 3 GROUP BY 1) x ON x.incident_id = tl.incident_id GROUP BY 1""")(lambda s, d: V.brief_stats(timeline(s, d)))
query("v05_key_evidence", _ALL + _LINE + """, o1 AS (SELECT *, row_number() OVER (PARTITION BY incident_id, signal_name, entity_id, time_str ORDER BY event_time, dedupe_key) AS n FROM tl),
 o5 AS (SELECT * EXCLUDE (n), CAST(row_number() OVER (PARTITION BY incident_id ORDER BY severity DESC, event_time DESC, dedupe_key) AS INTEGER) AS rank FROM o1 WHERE n = 1) SELECT * FROM o5 WHERE rank <= 5""")(lambda s, d: V.key_evidence(timeline(s, d)))
query("v09_severity_histogram", _ALL + _LINE + " SELECT incident_id, time_bucket(INTERVAL '3600 seconds', event_time) AS bin_start, CAST(sum(severity) AS BIGINT) AS severity FROM tl GROUP BY 1, 2")(lambda s, d: V.severity_histogram(timeline(s, d)))


@query("v06_heuristic_brief", _ALL + _LINE + """, b AS (SELECT * FROM inc ORDER BY score DESC, incident_id LIMIT 1)
 SELECT b.incident_id, root_entity_type || ':' || root_entity_id AS entity, count(*) AS total_signals, count(DISTINCT (signal_name, entity_id, tl.window_start)) AS unique_evidence, CAST(b.severity AS BIGINT) AS severity, CAST(round(any_value(b.score)) AS BIGINT) AS score, least(5, count(DISTINCT (signal_name, entity_id, time_str))) AS listed
 FROM b JOIN tl ON tl.incident_id = b.incident_id GROUP BY ALL""")
def v06(spark: SparkSession, d: str) -> DataFrame:
    """The brief of the incident with the highest score, and the figures that it tells."""
    a = assigned(spark, d)
    inc = C.incidents(a).orderBy(F.desc("score"), "incident_id").first()
    columns = "incident_id string, brief string"
    text = None
    if inc is not None:
        own = a.where(F.col("incident_id") == inc.incident_id)
        line = V.incident_evidence(own.drop("incident_id", "founder"), C.evidence(own))
        text = V.heuristic_brief(inc, V.brief_stats(line).first(), V.key_evidence(line).orderBy("rank").collect())
    brief = spark.createDataFrame([(inc.incident_id, text)] if text else [], columns)
    said = r"^(\S+) has (\d+) signals, (\d+) distinct, severity (\d+), score (\d+)\."
    told = lambda g: F.regexp_extract("brief", said, g)
    numbers = [told(g).cast("bigint").alias(n) for g, n in ((2, "total_signals"), (3, "unique_evidence"), (4, "severity"), (5, "score"))]
    return brief.select("incident_id", told(1).alias("entity"), *numbers, F.size(F.regexp_extract_all("brief", F.lit(r"(?m)^(\d+)\. "), F.lit(1))).cast("bigint").alias("listed"))


@query("v08_investigation_queries", f"WITH {EV} SELECT 'General Activity' AS title, count(*) AS n FROM ev WHERE host = 'host_1' AND event_time BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT 'Authentication Failures', count(*) FROM (SELECT DISTINCT username, src_ip FROM ev WHERE host = 'host_1' AND event_time BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND (rule_id = '4625' OR lower(signature) LIKE '%fail%'))")
def v08(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the investigation queries of a host, run as text."""
    normalized_events(spark, d).createOrReplaceTempView("normalized_events")
    out = None
    for q in V.investigation_queries("host", "host_1", "2024-01-02 00:00:00", "2024-01-20 00:00:00"):
        one = spark.sql(q["query"]).agg(F.count("*").alias("n")).select(F.lit(q["title"]).alias("title"), "n")
        out = one if out is None else out.union(one)
    return out


query("v10_status_colours", _ALL + " SELECT incident_id, CASE status WHEN 'NEW' THEN 'danger' ELSE 'secondary' END AS colour FROM inc")(lambda s, d: C.incidents(assigned(s, d)).select("incident_id", V.status_colour(F.col("status")).alias("colour")))

# Telemetry checks

_TAGGED = "(SELECT *, CASE WHEN raw_id % 2 = 0 THEN 'x LAB_HOST=' || host || ' end' ELSE '{\"lab_host\" : \"' || host || '\"}' END AS raw FROM ev WHERE raw_id % 3 > 0)"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """All events; the raw text of every third has no tag."""
    ev = normalized_events(spark, d)
    kv, js = F.concat(F.lit("x LAB_HOST="), "host", F.lit(" end")), F.concat(F.lit('{"lab_host" : "'), "host", F.lit('"}'))
    return ev.withColumn("raw", F.when(F.col("raw_id") % 3 > 0, F.when(F.col("raw_id") % 2 == 0, kv).otherwise(js)).otherwise("x end"))


query("q_rex", f"WITH {EV} SELECT host AS lab_host, count(*) AS n FROM {_TAGGED} GROUP BY 1")(lambda s, d: V.tagged_counts(tagged(s, d), "lab_host"))
query("q_find", f"WITH {EV} SELECT host, sourcetype, count(*) AS n FROM {_TAGGED} WHERE raw LIKE '%host_1%' OR raw LIKE '%host_3%' GROUP BY 1, 2")(lambda s, d: V.find_text(tagged(s, d), ["host_1", "host_3"], ["host", "sourcetype"]))


def indexed(spark: SparkSession, d: str) -> TextIndex:
    """Tagged events with an address in their text, behind an index."""
    found = TextIndex(spark, work_path(spark, "indexed"), blocks=4)
    found.add(tagged(spark, d).withColumn("raw", F.concat_ws(" ", "raw", F.concat(F.lit("from="), "src_ip"))))
    return found


query("q_find_indexed", f"WITH {EV} SELECT raw_id, host, src_ip FROM ev WHERE src_ip LIKE '%10.0.1.13%' OR raw_id % 3 > 0 AND host = 'host_3' AND raw_id % 2 = 0 AND event_time >= TIMESTAMP '2024-01-01'")(
    lambda s, d: indexed(s, d).find(["from=10.0.1.13", "LAB_HOST=host_3"]).select("raw_id", "host", "src_ip")
)
query("q_fresh", f"WITH {EV}, a AS (SELECT username, count(*) AS n, CAST(epoch(TIMESTAMP '2024-01-30 00:00:00') AS BIGINT) - CAST(floor(epoch(max(event_time))) AS BIGINT) AS age_sec FROM ev GROUP BY 1) SELECT *, CASE WHEN age_sec < 86400 THEN 'ALIVE' ELSE 'DEAD' END AS status FROM a")(
    lambda s, d: V.freshness(normalized_events(s, d), F.lit(datetime(2024, 1, 30)), 86400, "username")
)
query("q_cover", f"WITH {EV} SELECT host FROM (VALUES ('host_1'), ('host_9'), ('dc'), ('host_4')) x(host) WHERE host NOT IN (SELECT host FROM ev)")(
    lambda s, d: V.missing_hosts(s.createDataFrame([("host_1",), ("host_9",), ("dc",), ("host_4",)], "host string"), normalized_events(s, d))
)

# Table state and incremental selection

query("s11_idempotent_append", f"WITH {EV} SELECT host, min(raw_id) AS raw_id FROM ev WHERE host NOT IN ('host_1') GROUP BY 1")(
    lambda s, d: S.append_new(normalized_events(s, d).where("host = 'host_1'").select("host"), normalized_events(s, d).select("host", "raw_id"), ["host"], ["raw_id"])
)


@query("s12_upsert_profiles", f"WITH {EV} SELECT {_none('host')} AS entity_id, least(min(event_time), TIMESTAMP '2024-01-05 00:00:00') AS first_seen, greatest(max(event_time), TIMESTAMP '2024-01-06 00:00:00') AS last_seen, count(*) AS event_count FROM ev GROUP BY 1 UNION ALL SELECT 'old_host', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-06 00:00:00', 3")
def s12(spark: SparkSession, d: str) -> DataFrame:
    new = X.host_profiles(normalized_events(spark, d)).select("entity_id", "first_seen", "last_seen", "event_count")
    old = new.select("entity_id").union(spark.createDataFrame([("old_host",)], "entity_id string"))
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    old = old.select("entity_id", ntz("2024-01-05 00:00:00").alias("first_seen"), ntz("2024-01-06 00:00:00").alias("last_seen"), F.lit(3).cast("bigint").alias("event_count"))
    return S.upserted(old, new, ["entity_id"], {"first_seen": F.least("old.first_seen", "new.first_seen"), "last_seen": F.greatest("old.last_seen", "new.last_seen")})


query("s13_keyed_dedupe", f"WITH {EV} SELECT host, signature, max(raw_id) AS raw_id FROM ev GROUP BY 1, 2")(lambda s, d: S.latest_per_key(normalized_events(s, d).select("host", "signature", "raw_id"), ["host", "signature"], "raw_id"))
query("i01_unprocessed", f"WITH {EV} SELECT raw_id FROM ev WHERE raw_id NOT IN (SELECT raw_id FROM ev WHERE event_kind = 'web')")(
    lambda s, d: S.unprocessed(normalized_events(s, d).select("raw_id"), normalized_events(s, d).where("event_kind = 'web'"), "raw_id", "raw_id")
)
query("i03_i04_checkpoints", f"WITH {EV} SELECT vendor AS job, max(event_time) FILTER (raw_id % 2 = 0 OR raw_id % 3 = 0) AS last_window_end FROM ev WHERE raw_id % 2 = 0 OR raw_id % 3 = 0 GROUP BY 1")(
    lambda s, d: S.advance_checkpoints(*[normalized_events(s, d).where(F.col("raw_id") % n == 0).groupBy(F.col("vendor").alias("job")).agg(F.max("event_time").alias("last_window_end")) for n in (2, 3)])
)


@query("i05_i06_mark_processed", f"WITH {EV}, {FT}, {SIG} SELECT dedupe_key, CASE WHEN entity_type = 'ip' THEN TIMESTAMP '2024-02-01 00:00:00' END AS processed_at FROM sig")
def i06(spark: SparkSession, d: str) -> DataFrame:
    rows = signals(spark, d).select("dedupe_key", "entity_type", F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    waiting = rows.where("processed_at IS NULL AND entity_type = 'ip'")
    return S.mark_processed(rows, waiting, "dedupe_key", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("dedupe_key", "processed_at")


query("adapter_events", f"WITH {EV} SELECT * FROM ev")(normalized_events)


def v01_all(spark: SparkSession, d: str) -> DataFrame:
    a = assigned(spark, d)
    return V.incident_list(C.incidents(a), C.evidence(a))
