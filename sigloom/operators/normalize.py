"""Raw events to normalized ones, by native column expressions only.

The rules are steps over a frame that carries a working copy of each field; their order is
their meaning, as later steps override earlier ones.  JSON is read as a variant with functions
that give null where a value is missing or of another kind, so no row fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sigloom.functions.columns import either_match, event_time, filled, first_of, ipv4, match, stripped
from sigloom.params import DEFAULT, Compat
from sigloom.session import settle

COLUMNS = ["raw_id", "event_time", "vendor", "event_kind", "source", "sourcetype", "host", "src_ip", "dest_ip", "username", "rule_id", "signature", "severity", "http_method", "http_path", "http_status"]

# Patterns of the log formats.  (?d) makes a dot stop at line feeds only.
IP = r"(\d{1,3}(?:\.\d{1,3}){3})"
ACCESS_LOG = r'(?d)^(\S+) \S+ \S+ \[.*?\] "(.*?) (.*?) .*?" (\d+)'
WIN_SRC = r"SourceIp:\s*([\d\.]+)|Source Address:\s*([\d\.]+)"
WIN_DEST = r"DestinationIp:\s*([\d\.]+)|Destination Address:\s*([\d\.]+)"
WIN_USER = r"User:\s*([^\r\n]+)|Account Name:\s*([^\r\n]+)"
WIN_XML_USER = r"(?d)TargetUserName.*?>(.*?)<"
WIN_SOURCE = r"SourceName=([^\r\n]+)"
WIN_CODE = r"EventCode=(\d+)"
IDS_ID = r"\[(\d+:\d+:\d+)\]"
IDS_TEXT = r"(?d)\[\d+:\d+:\d+\]\s+(.*?)\s+\[Classification:"
IDS_TEXT_LOOSE = r"(?d)\]\s+(.*?)\s+\[Classification:"
IDS_PRIORITY = r"Priority: (\d+)"
ACTION = r"action (\w+) ([^\s]+)"
IDS_LINE = r"suricata|Classification:"
FLOW_START = "zenarmor: {"
FLOW = r"(?s)zenarmor: (\{.*\})\s*$"
SEVERITIES = {7: ["error", "critical", "high", "err", "severe"], 4: ["warn", "medium", "warning"], 1: ["info", "low", "informational"], 0: ["debug"]}


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A JSON value by path; keys may hold dots in bracket form."""
    return F.try_variant_get(v, path, kind)


def is_noise(raw_text: Column) -> Column:
    """Metric lines: the first character is a digit and there are five spaces in a row."""
    t = stripped(F.coalesce(raw_text, F.lit("")))
    return t.rlike(r"^\d") & t.contains("     ")


def classify(sourcetype: Column, source: Column) -> Column:
    """struct(vendor, kind) from the names of sourcetype and source."""
    st, src = F.lower(F.coalesce(sourcetype, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    pair = lambda v, k: F.struct(F.lit(v).alias("vendor"), F.lit(k).alias("kind"))
    windows = st.contains("wazuh") | st.contains("wineventlog")
    return (
        F.when(st.contains("wazuh-alerts"), pair("wazuh", "alert"))
        .when(windows & (src.contains("sysmon") | st.contains("sysmon")), pair("sysmon", "process"))
        .when(windows, pair("windows", "event"))
        .when(st.contains("opnsense") | st.contains("suricata") | src.contains("udp:5514"), pair("opnsense", "network"))
        .when(st.contains("nginx") | st.contains("juiceshop") | src.contains("access.log"), pair("juiceshop", "web"))
        .otherwise(pair("unknown", "unknown"))
    )


def xml_user(message: Column) -> Column:
    """The first of all user names in XML that isn't empty or a hyphen."""
    names = F.transform(F.regexp_extract_all(message, F.lit(WIN_XML_USER), F.lit(1)), stripped)
    return F.get(F.filter(names, lambda x: ~x.isin("", "-")), 0)


def windows_user(message: Column) -> Column:
    return F.coalesce(xml_user(message), stripped(either_match(message, WIN_USER)))


def word_severity(text: Column) -> Column:
    """Severity from a level's words; a list of levels counts by its text."""
    t = F.lower(text)
    return F.when(t.contains("error") | t.contains("crit"), "7").when(t.contains("warn"), "4").when(t.contains("info"), "1")


def level_severity(level: Column, is_text: Column) -> Column:
    """Severity from a rule level: 12 and up 7, 7 and up 4, else 1; a level that is no number stays as it is."""
    n = F.coalesce(level.try_cast("int"), F.when(~is_text, F.floor(level.try_cast("double")).cast("int")))
    absent = filled(level).isNull() | (~is_text & (n == 0)) | (~is_text & (level == "false"))
    return F.when(~absent, F.when(n >= 12, "7").when(n >= 7, "4").when(n.isNotNull(), "1").otherwise(level))


def canonical_severity(c: Column) -> Column:
    s = F.lower(stripped(c))
    out = F.when(filled(s).isNull(), 0)
    for value, words in SEVERITIES.items():
        out = out.when(s.isin(*words), value)
    return out.otherwise(F.coalesce(s.try_cast("int"), F.lit(0)))


def short_digest(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 8)


def _windows(df: DataFrame, compat: Compat) -> DataFrame:
    v, on = F.col("__v"), F.col("__windows")
    pick = lambda value, old: F.when(on, value).otherwise(F.col(old))
    m = F.col("__message")
    level_name = first_of(field(v, "$.Type"), field(v, "$.Level"), field(v, "$.LevelDisplayName"))
    level = field(v, "$.rule.level")
    has_rule = F.coalesce(field(v, "$.rule").startswith("{"), F.lit(False))
    text_level = F.coalesce(F.schema_of_variant(field(v, "$.rule.level", "variant")) == "STRING", F.lit(False))
    groups = F.coalesce(F.array_contains(field(v, "$.rule.groups", "array<string>"), "authentication_failed"), field(v, "$.rule.groups").contains("authentication_failed"), F.lit(False))
    missing = F.lit(None if compat.none_as_null else "None")
    code = F.coalesce(field(v, "$.EventCode"), F.when(field(v, "$.EventCode", "variant").isNotNull(), missing))
    text_rule = match(m, WIN_CODE)
    df = df.withColumns(
        {
            "src_ip": pick(either_match(m, WIN_SRC), "src_ip"),
            "dest_ip": pick(either_match(m, WIN_DEST), "dest_ip"),
            "username": pick(windows_user(m), "username"),
            "severity": pick(F.coalesce(F.when(has_rule, level_severity(level, text_level)), word_severity(level_name)), "severity"),
            "signature": pick(F.when(has_rule, field(v, "$.rule.description")), "signature"),
            "rule_id": pick(F.coalesce(code, text_rule, F.when(has_rule, F.coalesce(field(v, "$.rule.id"), missing))), "rule_id"),
            "event_kind": F.when(on & has_rule & groups, "alert").otherwise(F.col("event_kind")),
            "__win_source": stripped(match(m, WIN_SOURCE)),
        }
    )
    rule = F.col("rule_id")
    named = first_of(F.col("signature"), F.concat(F.lit("EventCode="), filled(rule)), F.concat(F.lit("SourceName="), F.col("__win_source")))
    lab = (rule == "4625") & F.upper(F.col("username")).contains("LAB_BURST")
    kind = F.when(rule.isin("3", "5156"), "network").when(rule == "4625", "alert").when(rule == "4624", "auth").otherwise(F.col("event_kind"))
    return df.withColumns(
        {
            "signature": pick(named, "signature"),
            "event_kind": pick(kind, "event_kind"),
            "severity": F.when(on & lab, "7").when(on & (rule == "4625"), "2").otherwise(F.col("severity")),
        }
    )


def _web(df: DataFrame, compat: Compat) -> DataFrame:
    v, on, raw = F.col("__v"), F.col("vendor") == "juiceshop", F.col("__raw")
    pick = lambda value, old: F.when(on, value).otherwise(F.col(old))
    part = lambda g: F.when(raw.rlike(ACCESS_LOG), F.regexp_extract(raw, ACCESS_LOG, g))
    status = part(4).try_cast("int")
    method, path = part(2), part(3)
    if compat.nested_app_json:
        body = F.coalesce(F.try_parse_json(raw), v)
        method, path = F.coalesce(method, field(body, "$.method")), F.coalesce(path, field(body, "$.path"))
        status = F.coalesce(status, field(body, "$.statusCode").try_cast("int"))
    host = F.when((F.coalesce("host", F.lit("")) == "") | (F.col("host") == "unknown"), first_of(F.col("dest_ip"), field(v, "$.dvc"), field(v, "$.container_name"), F.lit("juiceshop"))).otherwise(F.col("host"))
    df = df.withColumns(
        {
            "src_ip": pick(first_of(part(1), field(v, "$.clientip")), "src_ip"),
            "http_method": pick(method, "http_method"),
            "http_path": pick(path, "http_path"),
            "http_status": pick(status, "http_status"),
            "host": pick(host, "host"),
            "__clean": stripped(F.col("__message")),
        }
    )
    clean, low = F.col("__clean"), F.lower("__clean")
    app = on & (F.coalesce("http_status", F.lit(0)) == 0)
    short = F.when(F.length(clean) > 50, F.concat(F.substring(clean, 1, 50), F.lit(".."))).otherwise(clean)
    return df.withColumns(
        {
            "signature": F.when(app & (clean != ""), short).otherwise(F.col("signature")),
            "event_kind": F.when(app & low.contains("error:"), "alert").otherwise(F.col("event_kind")),
            "severity": F.when(app & low.contains("error:"), "error").when(app & low.contains("warn:"), "warn").otherwise(F.col("severity")),
        }
    )


def _firewall(df: DataFrame, compat: Compat) -> DataFrame:
    v, on = F.col("__v"), F.col("vendor") == "opnsense"
    alert = F.coalesce(field(v, "$.alert").isNotNull(), F.lit(False))
    payload = F.when(on, F.coalesce(filled(field(v, "$._raw")), F.col("__raw")))
    df = df.withColumns({"__p": payload, "__alert": on & alert})
    p, js = F.col("__p"), F.col("__alert")
    missing = F.lit(None if compat.none_as_null else "None")
    df = df.withColumns({"__ids": ~js & F.coalesce(p.rlike(IDS_LINE), F.lit(False)), "__flow": F.when(~js & p.contains(FLOW_START), F.try_parse_json(match(p, FLOW)))})
    ids, flow = F.col("__ids"), F.col("__flow")
    prio = F.when(ids, match(p, IDS_PRIORITY))
    in_flow = F.coalesce(F.schema_of_variant(flow).startswith("OBJECT"), F.lit(False))
    blocked = F.coalesce(field(flow, "$.is_blocked", "double") == 1, field(flow, "$.is_blocked", "boolean"), F.lit(False))
    proto = first_of(field(flow, "$.app_proto"), field(flow, "$.app_name"), field(flow, "$.transport_proto"), F.lit("unknown"))
    flow_text = F.concat_ws(":", F.lit("zenarmor"), F.when(blocked, "blocked").otherwise("allowed"), proto, first_of(field(flow, "$.direction"), F.lit("unknown")))
    ids_text = stripped(F.coalesce(match(p, IDS_TEXT), match(p, IDS_TEXT_LOOSE)))
    address = lambda key: filled(field(flow, f"$.{key}"))
    df = df.withColumns(
        {
            "src_ip": F.when(js, field(v, "$.src_ip")).when(on, F.coalesce(F.when(in_flow, address("src_ip")), match(p, IP))).otherwise(F.col("src_ip")),
            "dest_ip": F.when(js, field(v, "$.dest_ip")).when(on & in_flow, F.coalesce(address("dst_ip"), "dest_ip")).otherwise(F.col("dest_ip")),
            "signature": F.when(js, field(v, "$.alert.signature")).when(in_flow, flow_text).when(ids, ids_text).otherwise(F.col("signature")),
            "rule_id": F.when(js, F.coalesce(field(v, "$.alert.signature_id"), missing)).when(in_flow, F.concat(F.lit("flow:"), proto)).when(ids, match(p, IDS_ID)).otherwise(F.col("rule_id")),
            "event_kind": F.when(js, "ids").when(in_flow, F.when(blocked, "alert").otherwise("network")).when(ids, F.when(prio.try_cast("int").isin(1, 2), "alert").otherwise("ids")).otherwise(F.col("event_kind")),
            "severity": F.when(in_flow & blocked, "4").when(ids, F.create_map(*[F.lit(x) for x in (1, "7", 2, "4", 3, "1")])[F.coalesce(prio.try_cast("int"), F.lit(0))]).otherwise(F.col("severity")),
        }
    )
    bare = on & ~js & (F.coalesce("signature", F.lit("")) == "")
    slug = F.when(bare, match(p, ACTION, 2))
    df = df.withColumns(
        {
            "signature": F.when(slug.isNotNull(), F.concat_ws(" ", match(p, ACTION, 1), slug)).otherwise(F.col("signature")),
            "rule_id": F.coalesce(slug, "rule_id"),
            "event_kind": F.when(slug.isNotNull(), "network").otherwise(F.col("event_kind")),
        }
    )
    return df.withColumn("signature", F.when(on, first_of(F.col("signature"), field(v, "$.event_type"))).otherwise(F.col("signature")))


def _finished(df: DataFrame, compat: Compat) -> DataFrame:
    host = stripped(F.col("host"))
    host = F.when(host.rlike(r"^\d+\.\d+$"), "unknown").otherwise(host)
    df = df.withColumns({"severity": canonical_severity(F.col("severity")), "host": host, "src_ip": ipv4(F.col("src_ip"), compat.inet_text), "dest_ip": ipv4(F.col("dest_ip"), compat.inet_text)})
    infra = F.coalesce(F.col("host").contains("8088"), F.lit(False))
    first_kind = F.concat_ws(":", F.col("__class.vendor"), F.col("__class.kind"))
    signature = F.when(infra, "pipeline_noise").otherwise(F.col("signature"))
    rule = filled(F.coalesce(filled(F.col("rule_id")), F.col("__rule") if compat.envelope_rule_id else F.lit(None)))
    web = (F.col("__class.vendor") == "juiceshop") & filled(F.col("http_method")).isNotNull()
    request = F.concat_ws(" ", F.col("http_method"), first_of(F.col("http_path"), F.lit("/")))
    return df.withColumns(
        {
            "rule_id": F.coalesce(rule, short_digest(F.coalesce(filled(signature), first_kind))),
            "signature": F.coalesce(filled(signature), F.when(web, request), first_kind),
            "vendor": F.when(infra, "infra").otherwise(F.col("vendor")),
            "event_kind": F.when(infra, "metric").otherwise(F.col("event_kind")),
            "severity": F.when(infra, 0).otherwise(F.col("severity")),
        }
    )


def normalize(raw: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """Normalized events of raw ones (id, event_time, sourcetype, source, host, raw_json, raw_text).

    Metric lines and rows without any time are left out.  A payload that isn't JSON counts as an empty object, so its row
    is read from the raw text; of a key that a payload repeats the last value counts.  :func:`rejected` lists all three.
    """
    return _prepared(raw, compat).where(~F.col("__noise") & F.col("event_time").isNotNull()).select(*COLUMNS)


def rejected(raw: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """(raw_id, reason) of the rows that :func:`normalize` leaves out and, as a warning, of those whose payload it can't read."""
    bad = _prepared(raw, compat).where(F.col("__noise") | F.col("__broken") | F.col("event_time").isNull())
    return bad.select("raw_id", F.when(F.col("__noise"), "metric line").when(F.col("event_time").isNull(), "no time").otherwise("broken payload").alias("reason"))


def _prepared(raw: DataFrame, compat: Compat) -> DataFrame:
    settle(raw.sparkSession)
    null = F.lit(None).cast("string")
    read = F.try_parse_json("raw_json")
    v = F.coalesce(read, F.parse_json(F.lit("{}")))
    broken = filled(F.col("raw_json")).isNotNull() & read.isNull()
    df = raw.withColumns({"__v": v, "__broken": broken, "__class": classify(F.col("sourcetype"), F.col("source")), "__noise": is_noise(F.col("raw_text"))})
    text = F.coalesce(filled(F.col("raw_text")), filled(field(F.col("__v"), "$._raw")), F.lit(""))
    df = df.withColumn("__raw", text).withColumn("__message", F.coalesce(filled(field(F.col("__v"), "$.Message")), F.col("__raw")))
    df = df.withColumns(
        {
            "raw_id": F.col("id"),
            "event_time": F.coalesce("event_time", event_time(field(F.col("__v"), "$._time"))),
            "vendor": F.col("__class.vendor"),
            "event_kind": F.col("__class.kind"),
            "__windows": F.col("__class.vendor").isin("wazuh", "sysmon", "windows"),
            "__rule": F.col("rule_id") if "rule_id" in raw.columns else null,
            **{c: null for c in ("src_ip", "dest_ip", "username", "rule_id", "signature", "severity", "http_method", "http_path")},
            "http_status": F.lit(None).cast("int"),
        }
    )
    for step in (_windows, _web, _firewall, _finished):
        df = step(df, compat)
    return df


def extras(raw_json: Column) -> Column:
    """What a payload holds besides the fields that are stored elsewhere."""
    m = F.from_json(raw_json, "map<string,string>")
    return F.map_filter(m, lambda k, _: ~k.isin("_raw", "_time", "_cd", "Message"))


def key_values(text: Column) -> Column:
    """KEY=VALUE lines as a map; of repeated keys the last counts."""
    pairs = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(stripped(F.substring_index(x, "=", 1)).alias("k"), stripped(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def inner_json(v: Column, path: str = "$") -> Column:
    """The JSON object held as text in a payload's _raw, or a value in it."""
    return field(F.try_parse_json(field(v, "$._raw")), path, "variant")
