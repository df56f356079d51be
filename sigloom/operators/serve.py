"""What an analyst reads: incident lists, evidence, briefs, histograms and search text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

STATUS_COLOURS = {"NEW": "danger", "ACTIVE": "warning", "CLOSED": "success"}
TIME_CHOICES = (4, 24, 168)


def shown_time(c: Column, hours: int = 2) -> Column:
    return F.date_format(c + F.expr(f"INTERVAL '{hours}' HOUR"), "yyyy-MM-dd HH:mm:ss")


def incident_list(incidents: DataFrame, evidence: DataFrame, as_of: Column | None = None, hours: int = 24, status: str | None = None) -> DataFrame:
    """Incidents updated in the last hours, with their number of signals, latest first."""
    rows = incidents if as_of is None else incidents.where(F.col("last_update_time") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR"))
    rows = rows if status is None else rows.where(F.col("status") == status)
    n = evidence.groupBy("incident_id").agg(F.count("*").alias("evidence_count"))
    out = rows.join(n, "incident_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    return out.withColumn("last_update_str", shown_time(F.col("last_update_time"))).orderBy(F.desc("last_update_time"), "incident_id")


def incident_details(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where(F.col("incident_id") == incident_id)


def incident_evidence(signals: DataFrame, evidence: DataFrame, incident_id: str | None = None) -> DataFrame:
    """An incident's signals by time; without an id, those of all incidents."""
    own = evidence if incident_id is None else evidence.where(F.col("incident_id") == incident_id)
    rows = signals.join(own, signals.dedupe_key == own.signal_id).drop("signal_id")
    return rows.withColumn("time_str", shown_time(F.col("event_time"))).orderBy("incident_id", "event_time", "dedupe_key")


def brief_stats(timeline: DataFrame) -> DataFrame:
    """By incident: signals, distinct (name, entity, window start) and the three most frequent names."""
    sums = timeline.groupBy("incident_id").agg(F.count("*").alias("total_signals"), F.countDistinct("signal_name", "entity_id", "window_start").alias("unique_evidence"))
    names = timeline.groupBy("incident_id", "signal_name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("incident_id").orderBy(F.desc("n"), "signal_name")
    top = names.withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "signal_name"))), lambda x: x["signal_name"])
    return sums.join(top.groupBy("incident_id").agg(F.array_join(listed, ", ").alias("top_types")), "incident_id")


def key_evidence(timeline: DataFrame, n: int = 5) -> DataFrame:
    """By incident: the first of each (name, entity, time), the n most severe and latest of them."""
    once = Window.partitionBy("incident_id", "signal_name", "entity_id", "time_str").orderBy("event_time", "dedupe_key")
    best = Window.partitionBy("incident_id").orderBy(F.desc("severity"), F.desc("event_time"), "dedupe_key")
    kept = timeline.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def heuristic_brief(incident: Row | None, stats: Row | None, key: list[Row]) -> str:
    """A Markdown brief of one incident, from a row of each table and its key evidence."""
    if incident is None or stats is None:
        return "No evidence found for this incident."
    lines = [
        f"{incident.root_entity_type}:{incident.root_entity_id} has {stats.total_signals} signals, {stats.unique_evidence} distinct, severity {incident.severity}, score {incident.score:.0f}.",
        f"From {incident.start_time} to {incident.last_update_time} (UTC); mostly {stats.top_types}.",
        "",
        *(f"{n}. {r.time_str} {r.entity_id}: {r.signal_name} (severity {r.severity})" for n, r in enumerate(key, 1)),
    ]
    # What else to read: the other entities in the evidence, and the searches there are for this kind of entity.
    others = sorted({r.entity_id for r in key} - {incident.root_entity_id})
    lines += ["", f"Also involved: {', '.join(others)}."] if others else []
    searches = investigation_queries(incident.root_entity_type, incident.root_entity_id, str(incident.start_time), str(incident.last_update_time))
    return "\n".join(lines + [f"Search: {q['title']}." for q in searches])


def written_brief(incident: Row, stats: Row, key: list[Row], write: Callable[[str], str] | None = None) -> str:
    """A brief by the given writer, or the heuristic one if there is none or it fails."""
    plain = heuristic_brief(incident, stats, key)
    if write is None:
        return plain
    try:
        return write(plain)
    except Exception as e:
        return f"**Note:** the writer failed ({e}).\n\n{plain}"


def investigation_queries(entity_type: str, entity_id: str, start: str, end: str) -> list[dict[str, str]]:
    """Spark SQL over normalized_events for an analyst to run, by kind of entity.  The titles are fixed values."""
    quote = lambda s: "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"
    who, span = quote(entity_id), f"event_time BETWEEN TIMESTAMP {quote(start)} AND TIMESTAMP {quote(end)}"
    if entity_type in ("host", "ip", "src_ip", "dest_ip"):
        any_side = f"(host = {who} OR src_ip = {who} OR dest_ip = {who})"
        return [
            {"title": "General Activity", "query": f"SELECT event_time, source, sourcetype, rule_id, src_ip, dest_ip, username FROM normalized_events WHERE {span} AND {any_side} ORDER BY event_time"},
            {"title": "Authentication Failures", "query": f"SELECT username, src_ip, count(*) AS n FROM normalized_events WHERE {span} AND (host = {who} OR src_ip = {who}) AND (rule_id = '4625' OR lower(signature) LIKE '%fail%') GROUP BY username, src_ip"},
        ]
    if entity_type == "user":
        return [{"title": "User Activity", "query": f"SELECT host, sourcetype, rule_id, count(*) AS n FROM normalized_events WHERE {span} AND username = {who} GROUP BY host, sourcetype, rule_id"}]
    return []


def severity_histogram(timeline: DataFrame, seconds: int = 3600) -> DataFrame:
    return timeline.groupBy("incident_id", F.window("event_time", f"{seconds} seconds")["start"].alias("bin_start")).agg(F.sum("severity").alias("severity"))


def status_colour(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in STATUS_COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit("secondary"))


# Telemetry checks


def tagged_value(raw: Column, name: str, word: str = r"\w+") -> Column:
    """name=value, or "name": "value" in JSON."""
    from sigloom.functions.columns import match

    return F.coalesce(match(raw, rf"(?i)\b{name}=({word})"), match(raw, rf'"{name}"\s*:\s*"([^"]+)"'))


def tagged_counts(events: DataFrame, name: str) -> DataFrame:
    return events.select(tagged_value(F.col("raw"), name).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def freshness(events: DataFrame, as_of: Column, seconds: int = 900, by: str = "sourcetype", time: str = "event_time") -> DataFrame:
    """By dataset: rows, age of the latest, ALIVE if younger than the limit, else DEAD."""
    rows = events.groupBy(by).agg(F.count("*").alias("n"), F.max(time).alias("latest"))
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp"))
    return rows.select(by, "n", age.alias("age_sec"), F.when(age < seconds, "ALIVE").otherwise("DEAD").alias("status"))


def missing_hosts(expected: DataFrame, events: DataFrame, key: str = "host") -> DataFrame:
    return expected.join(events.select(key).distinct(), key, "left_anti")


def find_text(events: DataFrame, words: list[str], by: list[str], column: str = "raw") -> DataFrame:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col(column).contains(w)
    return events.where(hit).groupBy(*by).agg(F.count("*").alias("n"))
