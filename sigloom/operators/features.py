"""Entity features: per-minute and five-minute rollups in one long table, and entity profiles.

All features of a table come from one scan and one shuffle: each event gives an array of the
features it counts for, which is exploded and counted by bin and key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigloom.functions.columns import filled
from sigloom.params import DEFAULT, Compat

#: Signatures that count as bad, and profile noise.
SUSPICIOUS = ["ET TROJAN", "ET MALWARE", "ET POLICY", "ET INFO External IP", "Wazuh: Critical", "Auth Failure"]
PROFILE_NOISE = ["allowed", "zenarmor:allowed", "ICMP ping"]
AUTH_PHRASES = ["failed password", "authentication failed", "invalid user", "logon failure", "login failed"]

BASELINE = ["event_count", "error_rate"]
KEYS = ["bin_start", "bin_size_sec", "feature_name", "entity_type", "entity_id", "secondary_type", "secondary_id"]
COLUMNS = ["bin_start", "bin_size_sec", "vendor", "feature_name", "entity_type", "entity_id", "secondary_type", "secondary_id", "value", "n_events"]


def bin_start(c: Column, seconds: int) -> Column:
    """Start of the event's bin, of the event time's own type."""
    return F.window(c, f"{seconds} seconds")["start"]


def contains_any(c: Column, words: list[str]) -> Column:
    """Case-insensitive: any of the words occurs."""
    return F.coalesce(F.lower(c).rlike("|".join(w.lower().replace(".", r"\.") for w in words)), F.lit(False))


@dataclass(frozen=True)
class Feature:
    name: str
    entity_type: str
    entity: str
    when: Column
    vendor: str | None = None  # None: the vendors seen
    secondary: str | None = None
    secondary_type: str = "-"
    unknown: str = "unknown"  # stands for a missing entity
    mean: Column | None = None  # the value is its mean, not the number of events


def minute_features() -> list[Feature]:
    c = F.col
    fail = c("rule_id") == "4625"
    status = F.coalesce(c("http_status"), F.lit(0)) >= 400
    return [
        Feature("auth_fail_count", "host", "host", fail, "wazuh"),
        Feature("auth_success_count", "host", "host", c("rule_id") == "4624", "wazuh"),
        Feature("auth_fail_count", "user", "username", fail & c("username").isNotNull(), "wazuh"),
        Feature("src_ip_fail_count", "host", "host", fail & c("src_ip").isNotNull(), "wazuh", "src_ip", "src_ip"),
        Feature("wazuh_alert_count", "host", "host", c("vendor") == "wazuh", "wazuh"),
        Feature("juiceshop_error_count", "endpoint", "http_path", (c("vendor") == "juiceshop") & (status | (c("event_kind") == "alert")), "juiceshop"),
        Feature("bad_event_count", "host", "host", (F.coalesce(c("severity"), F.lit(0)) >= 5) | status | contains_any(c("signature"), SUSPICIOUS)),
        Feature("zenarmor_allowed_count", "host", "host", (c("vendor") == "opnsense") & contains_any(c("signature"), ["allowed"])),
        Feature("signature_count", "host", "host", c("signature").isNotNull(), None, "signature", "signature"),
        Feature("src_ip_count", "host", "host", c("src_ip").isNotNull(), None, "src_ip", "src_ip"),
    ]


def baseline_features() -> list[Feature]:
    """What the baselines of hosts and endpoints need besides: all events, and the share of failed requests."""
    failed = F.coalesce((F.col("http_status") >= 400).cast("double"), F.lit(0.0))
    return [
        Feature("event_count", "host", "host", F.lit(True), unknown="(none)"),
        Feature("error_rate", "endpoint", "http_path", F.col("sourcetype") == "juiceshop:app", unknown="(none)", mean=failed),
    ]


def since(events: DataFrame, as_of: Column | None, lookback_minutes: int, seconds: int, compat: Compat = DEFAULT) -> DataFrame:
    """Events of the lookback; its start moves down to a bin's, so that no bin is counted in part."""
    if as_of is None:
        return events
    start = as_of - F.expr(f"INTERVAL '{lookback_minutes}' MINUTE")
    if compat.align_bins:
        return events.where(F.col("event_time") >= bin_start_of(start, seconds))
    return events.where(F.col("event_time") > start)


def bin_start_of(c: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(c.cast("timestamp")) / seconds) * seconds)


def tags(features: list[Feature], compat: Compat = DEFAULT) -> Column:
    """What an event counts for: an array of features with their keys, and the number whose mean a value is, if it is one."""
    def tag(f: Feature) -> Column:
        second = F.coalesce(F.col(f.secondary), F.lit("unknown")) if f.secondary else F.lit("-")
        if f.secondary == "src_ip" and compat.inet_text:
            second = F.concat(second, F.lit("/32"))
        entity = F.col(f.entity) if f.unknown == "unknown" else filled(F.col(f.entity))
        mean = [] if _counts(features) else [(F.lit(None).cast("double") if f.mean is None else f.mean).alias("mean")]
        return F.when(f.when, F.struct(F.lit(f.name).alias("feature_name"), F.lit(f.entity_type).alias("entity_type"), F.coalesce(entity, F.lit(f.unknown)).alias("entity_id"), F.lit(f.secondary_type).alias("secondary_type"), second.alias("secondary_id"), F.coalesce(F.lit(f.vendor), F.col("vendor")).alias("vendor"), *mean))

    return F.array_compact(F.array(*map(tag, features)))


def _counts(features: list[Feature]) -> bool:
    return all(f.mean is None for f in features)


def minute_rollup(events: DataFrame, bin_size_sec: int = 60, as_of: Column | None = None, lookback_minutes: int = 60, features: list[Feature] | None = None, compat: Compat = DEFAULT) -> DataFrame:
    """The long feature table of normalized events, a row for each bin and key."""
    features = features or minute_features()
    counts = _counts(features)
    rows = since(events, as_of, lookback_minutes, bin_size_sec, compat)
    flat = rows.select(bin_start(F.col("event_time"), bin_size_sec).alias("bin_start"), F.explode(tags(features, compat)).alias("f")).select("bin_start", F.lit(bin_size_sec).alias("bin_size_sec"), "f.*")
    mean = [] if counts else [F.avg("mean").alias("mean")]
    out = flat.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("vendor")), ",").alias("vendor"), F.count("*").alias("n"), *mean)
    value = F.col("n").cast("double")
    return out.withColumn("value", value if counts else F.coalesce("mean", value)).withColumn("n_events", F.col("n").cast("int")).select(*COLUMNS)


def minute_rollup_apart(events: DataFrame, bin_size_sec: int = 60) -> DataFrame:
    """The same, with a scan and an aggregate for each feature: what the fused form is tested against."""
    out = None
    for f in minute_features():
        one = minute_rollup(events, bin_size_sec, features=[f])
        out = one if out is None else out.unionByName(one)
    return out


def entity_stats(features: DataFrame) -> DataFrame:
    """First and last bin and number of counted events of each entity: one pass over all its rows.

    Rows that only baselines need (:func:`baseline_features`) count nothing twice: they are left out.
    """
    return features.where(~F.col("feature_name").isin(BASELINE)).groupBy("entity_type", "entity_id").agg(F.min("bin_start").alias("first_seen"), F.max("bin_start").alias("last_seen"), F.sum("n_events").cast("bigint").alias("event_count"))


def top_signatures(features: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """(entity_type, entity_id, top_signatures): JSON of signatures and counts, most frequent first, then by name."""
    counted = features.where((F.col("feature_name") == "signature_count") & ~contains_any(F.col("secondary_id"), PROFILE_NOISE))
    counted = counted.groupBy("entity_type", "entity_id", "secondary_id").agg(F.sum("value").cast("bigint").alias("n"))
    if compat.top_n is not None:
        best = Window.partitionBy("entity_type", "entity_id").orderBy(F.desc("n"), "secondary_id")
        counted = counted.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= compat.top_n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("secondary_id").alias("sig"))))
    shown = F.transform(listed, lambda x: F.struct(x["sig"].alias("sig"), (-x["o"]).alias("count")))
    return counted.groupBy("entity_type", "entity_id").agg(F.to_json(shown).alias("top_signatures"))


def unique_src_ips(features: DataFrame) -> DataFrame:
    seen = features.where("feature_name = 'src_ip_count'")
    return seen.groupBy("entity_type", "entity_id").agg(F.countDistinct("secondary_id").alias("unique_src_ips"))


def profiles(features: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """Entity statistics with both enrichments."""
    keys = ["entity_type", "entity_id"]
    return entity_stats(features).join(unique_src_ips(features), keys, "left").join(top_signatures(features, compat), keys, "left")


# Five-minute rollups over the whole history; missing keys are "(none)".


def named(c: str) -> Column:
    """A key, "(none)" where it is missing."""
    return F.coalesce(filled(F.col(c)), F.lit("(none)"))


def _auth_failure() -> Column:
    hit = (F.col("sourcetype") == "wazuh-alerts") & contains_any(F.col("signature"), AUTH_PHRASES)
    return F.coalesce(hit, F.lit(False)).cast("int")


def _metric(rows: DataFrame, kind: str, metric: str, entity: Column, value: Column, meta: Column | None = None, seconds: int = 300) -> DataFrame:
    binned = rows.withColumn("bin_start", bin_start(F.col("event_time"), seconds)).withColumn("entity_id", entity)
    aggs = [value.cast("double").alias("value"), F.count("*").cast("int").alias("n_events"), (F.lit(None).cast("string") if meta is None else meta).alias("meta")]
    out = binned.groupBy("bin_start", "entity_id").agg(*aggs)
    return out.select("bin_start", F.lit(seconds).alias("bin_size_sec"), F.lit(metric).alias("feature_name"), F.lit(kind).alias("entity_type"), "entity_id", "value", "n_events", "meta")


def host_counts(events: DataFrame, seconds: int = 300) -> DataFrame:
    return _metric(events, "host", "event_count", named("host"), F.count("*"), seconds=seconds)


def signature_counts(events: DataFrame, seconds: int = 300) -> DataFrame:
    """A row for each bin and signature; meta lists the sourcetypes seen."""
    rows = events.where(filled(F.col("signature")).isNotNull())
    seen = F.to_json(F.struct(F.array_sort(F.collect_set("sourcetype")).alias("sourcetype")))
    return _metric(rows, "signature", "event_count", F.col("signature"), F.count("*"), seen, seconds)


def rule_counts(events: DataFrame, seconds: int = 300) -> DataFrame:
    return _metric(events.where("sourcetype = 'wazuh-alerts'"), "rule_id", "event_count", named("rule_id"), F.count("*"), seconds=seconds)


def auth_failures(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Flagged failures by host and by user, bins without any included."""
    both = events.withColumn("__fail", _auth_failure())
    sides = F.explode(F.array(F.struct(F.lit("host").alias("t"), named("host").alias("i")), F.struct(F.lit("user").alias("t"), named("username").alias("i"))))
    flat = both.select(bin_start(F.col("event_time"), seconds).alias("bin_start"), "__fail", sides.alias("x"))
    out = flat.groupBy("bin_start", "x").agg(F.sum("__fail").cast("double").alias("value"), F.count("*").cast("int").alias("n_events"))
    return out.select("bin_start", F.lit(seconds).alias("bin_size_sec"), F.lit("auth_fail_count").alias("feature_name"), F.col("x.t").alias("entity_type"), F.col("x.i").alias("entity_id"), "value", "n_events", F.lit(None).cast("string").alias("meta"))


def top_src_ips(events: DataFrame, seconds: int = 300, n: int = 5) -> DataFrame:
    """(bin_start, host, rank, src_ip, count) of the n most frequent addresses; ties by address."""
    seen = events.where("src_ip IS NOT NULL").select(bin_start(F.col("event_time"), seconds).alias("bin_start"), named("host").alias("host"), "src_ip")
    counts = seen.groupBy("bin_start", "host", "src_ip").agg(F.count("*").alias("count"))
    best = Window.partitionBy("bin_start", "host").orderBy(F.desc("count"), "src_ip")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def top_src_ip_json(events: DataFrame, seconds: int = 300, n: int = 5) -> DataFrame:
    top = top_src_ips(events, seconds, n).groupBy("bin_start", "host").agg(F.array_sort(F.collect_list(F.struct("rank", "src_ip", "count"))).alias("x"))
    listed = F.transform("x", lambda r: F.struct(r["src_ip"].alias("src_ip"), r["count"].alias("count")))
    return top.select("bin_start", F.lit(seconds).alias("bin_size_sec"), F.lit("top_src_ip").alias("feature_name"), F.lit("host").alias("entity_type"), F.col("host").alias("entity_id"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("n_events"), F.to_json(F.struct(listed.alias("top"))).alias("meta"))


def error_rates(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Share of failed requests by endpoint; a request without a status is no failure."""
    bad = F.coalesce((F.col("http_status") >= 400).cast("int"), F.lit(0))
    meta = F.to_json(F.struct(F.count("*").alias("total"), F.sum(bad).alias("errors")))
    return _metric(events.where("sourcetype = 'juiceshop:app'"), "endpoint", "error_rate", named("http_path"), F.avg(bad), meta, seconds)


def host_profiles(events: DataFrame) -> DataFrame:
    return events.groupBy(F.lit("host").alias("entity_type"), named("host").alias("entity_id")).agg(
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        F.count("*").alias("event_count"),
        F.countDistinct("src_ip").alias("unique_src_ips"),
        F.countDistinct(filled(F.col("username"))).alias("unique_users"),
    )


def five_minute_rollup(events: DataFrame, seconds: int = 300) -> DataFrame:
    """All five-minute metrics from one scan: each event gives an array of what it counts for, counted by key and then ranked."""
    bad = F.coalesce((F.col("http_status") >= 400).cast("int"), F.lit(0))
    null = F.lit(None).cast("string")

    def tag(name: str, kind: str, entity: Column, value: Column, when: Column | None = None, other: Column = null, seen: Column = null) -> Column:
        made = F.struct(F.lit(name).alias("feature_name"), F.lit(kind).alias("entity_type"), entity.alias("entity_id"), value.cast("bigint").alias("v"), other.alias("other"), seen.alias("seen"))
        return made if when is None else F.when(when, made)

    one = F.lit(1)
    tags = [
        tag("event_count", "host", named("host"), one),
        tag("event_count", "signature", F.col("signature"), one, filled(F.col("signature")).isNotNull(), seen=F.col("sourcetype")),
        tag("event_count", "rule_id", named("rule_id"), one, F.col("sourcetype") == "wazuh-alerts"),
        tag("auth_fail_count", "host", named("host"), _auth_failure()),
        tag("auth_fail_count", "user", named("username"), _auth_failure()),
        tag("top_src_ip", "host", named("host"), one, F.col("src_ip").isNotNull(), other=F.col("src_ip")),
        tag("error_rate", "endpoint", named("http_path"), bad, F.col("sourcetype") == "juiceshop:app"),
    ]
    keys = ["bin_start", "feature_name", "entity_type", "entity_id"]
    flat = events.select(bin_start(F.col("event_time"), seconds).alias("bin_start"), F.explode(F.array_compact(F.array(*tags))).alias("x")).select("bin_start", "x.*")
    counted = flat.groupBy(*keys, "other").agg(F.sum("v").alias("v"), F.count("*").alias("n"), F.collect_set("seen").alias("seen"))
    # Only addresses have more than one row a key; of them the first five are kept.
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "other"))).where("rank <= 5")
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", "n"))), lambda r: F.struct(r["other"].alias("src_ip"), r["n"].alias("count")))
    out = ranked.groupBy(*keys).agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.first("seen").alias("seen"), top.alias("top"))
    name, is_top = F.col("feature_name"), F.col("feature_name") == "top_src_ip"
    value = F.when(~is_top, F.when(name == "error_rate", F.col("v") / F.col("n")).otherwise(F.col("v").cast("double")))
    meta = (
        F.when(is_top, F.to_json(F.struct("top")))
        .when(name == "error_rate", F.to_json(F.struct(F.col("n").alias("total"), F.col("v").alias("errors"))))
        .when(F.col("entity_type") == "signature", F.to_json(F.struct(F.array_sort("seen").alias("sourcetype"))))
    )
    return out.select("bin_start", F.lit(seconds).alias("bin_size_sec"), "feature_name", "entity_type", "entity_id", value.alias("value"), F.when(~is_top, F.col("n").cast("int")).alias("n_events"), meta.alias("meta"))
