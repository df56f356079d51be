"""Sample files and search exports to events: JSON texts to one JSON object a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigloom.functions.columns import event_key, event_time, first_of, stripped

RAW_COLUMNS = ["event_key", "event_time", "sourcetype", "source", "host", "agent_name", "rule_id", "raw_json", "raw_text"]


def _kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def _variant(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def parse_files(files: DataFrame) -> DataFrame:
    """(path, event): events, as JSON text, of whole files (path, value).

    A file is a JSON array, {"results": [...]}, {"result": {...}}, one object, or else JSON
    lines, each perhaps in a wrapper; a byte-order mark and lines that don't parse are skipped.
    """
    # The parser stops after one value: a file whose first line is one and that has more lines is JSON lines.
    text = F.regexp_replace("value", "^﻿", "")
    rows = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")
    apart = (F.size(rows) > 1) & F.try_parse_json(F.get(rows, 0)).isNotNull()
    whole = files.select("path", text.alias("text"), F.when(~apart, F.try_parse_json(text)).alias("v"))
    v = F.col("v")
    results, result = _variant(v, "$.results"), _variant(v, "$.result")
    many = F.when(_kind(v) == "ARRAY", v).when(_kind(results) == "ARRAY", results)
    listed = whole.where(many.isNotNull()).select("path", F.explode(many.try_cast("array<variant>")).alias("e"))
    one = whole.where(many.isNull() & (_kind(v) == "OBJECT")).select("path", F.when(_kind(result) == "OBJECT", result).otherwise(v).alias("e"))
    lines = whole.where(v.isNull()).select("path", F.explode(F.split("text", "\n")).alias("line")).select("path", F.try_parse_json(stripped(F.col("line"))).alias("e"))
    lines = lines.where("e IS NOT NULL").select("path", F.coalesce(_variant(F.col("e"), "$.result"), "e").alias("e"))
    return listed.union(one).union(lines).where(_kind(F.col("e")) == "OBJECT").select("path", F.to_json("e").alias("event"))


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parse_files(files)


def retimed(events: DataFrame, as_of: Column) -> DataFrame:
    """Events with their time set to one instant, in epoch seconds."""
    rest = F.map_filter(F.from_json("event", "map<string,string>"), lambda k, _: k != "_time")
    seconds = F.format_string("%.6f", F.unix_micros(as_of.cast("timestamp")) / 1_000_000)
    return events.withColumn("event", F.to_json(F.map_concat(rest, F.create_map(F.lit("_time"), seconds))))


def export_events(lines: DataFrame, unwrap: bool = True) -> DataFrame:
    """(event) of an export's lines (value): those that start with a brace, their ``result`` taken out.

    With ``unwrap=False`` every line that parses is an event.
    """
    v = F.try_parse_json("value")
    if not unwrap:
        return lines.select(v.alias("e")).where("e IS NOT NULL").select(F.to_json("e").alias("event"))
    own = lines.where(stripped(F.col("value")).startswith("{")).select(_variant(v, "$.result").alias("e"))
    return own.where("e IS NOT NULL").select(F.to_json("e").alias("event"))


def envelope(events: DataFrame) -> DataFrame:
    """Raw rows (``RAW_COLUMNS``) of events (event as JSON text).

    Keys with a dot are flat keys of the event.  Without ``_raw`` the event's text is the raw text.
    """
    v = F.col("__v")
    get = lambda *keys: [F.try_variant_get(v, f"$['{k}']", "string") for k in keys]
    at = lambda k: get(k)[0]
    rows = events.withColumn("__v", F.try_parse_json("event"))
    return rows.select(
        event_key(at("_cd"), *get("_time", "sourcetype", "source", "host", "_raw")).alias("event_key"),
        event_time(at("_time")).alias("event_time"),
        at("sourcetype").alias("sourcetype"),
        at("source").alias("source"),
        at("host").alias("host"),
        first_of(*get("agent.name", "agent_name")).alias("agent_name"),
        first_of(*get("rule.id", "rule_id")).alias("rule_id"),
        F.col("event").alias("raw_json"),
        F.coalesce(at("_raw"), F.col("event")).alias("raw_text"),
    )


def with_row_ids(raw: DataFrame) -> DataFrame:
    """``raw`` with a number for each key, the same on every run: a 63-bit hash of the key."""
    return raw.withColumn("id", F.xxhash64("event_key").bitwiseAND(F.lit(2**63 - 1)))


__all__ = ["RAW_COLUMNS", "envelope", "export_events", "parse_files", "read_files", "retimed", "with_row_ids"]
