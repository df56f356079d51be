"""Column helpers: blanks, stripping, regular expressions, addresses, times and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OFFSETS = {"UTC": "+00:00", "CAT": "+02:00", "SAST": "+02:00"}
_OCTET = r"(25[0-5]|2[0-4]\d|[01]?\d?\d)"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*map(filled, cs))


def stripped(c: Column) -> Column:
    """Without whitespace, of any kind, at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return filled(F.regexp_extract(c, pattern, group))


def either_match(c: Column, pattern: str) -> Column:
    """The first or second group, of a pattern with two alternatives."""
    return F.coalesce(match(c, pattern, 1), match(c, pattern, 2))


def ipv4(c: Column, inet_text: bool = False) -> Column:
    """A dotted quad with parts up to 255, stripped; null for all else."""
    v = stripped(c)
    return F.when(v.rlike(_IPV4), F.concat(v, F.lit("/32")) if inet_text else v)


def event_time(c: Column) -> Column:
    """Epoch seconds, ISO 8601, or a date and time with UTC, CAT, SAST or no zone (UTC); else null."""
    s = stripped(c)
    number = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    epoch = F.when(number, F.timestamp_micros(F.round(s.try_cast("double") * 1_000_000).try_cast("bigint")))
    iso = F.regexp_replace(s, "Z$", "+00:00")
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"), iso.try_cast("timestamp"))
    zoned = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\s+(UTC|CAT|SAST)$"
    offset = F.create_map(*[F.lit(x) for kv in OFFSETS.items() for x in kv])
    base = F.regexp_replace(match(s, zoned, 1), r"\s+", " ")
    named = F.when(s.rlike(zoned), F.concat(base, F.try_element_at(offset, match(s, zoned, 2))).try_cast("timestamp"))
    return F.coalesce(epoch, iso, named)


def iso_time(c: Column) -> Column:
    """UTC ISO 8601 with +00:00, and microseconds only where there are any."""
    c = c.cast("timestamp")
    whole = F.pmod(F.unix_micros(c), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def event_key(cd: Column, *core: Column) -> Column:
    """The search server's own key, or a digest of the core fields (time, sourcetype, source, host, raw)."""
    base = F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in core])
    return F.when(filled(cd).isNotNull(), F.concat(F.lit("splunk:"), cd)).otherwise(F.concat(F.lit("hash:"), F.sha2(base, 256)))


def backfill_key(cd: Column, *core: Column) -> Column:
    """The key given to rows stored before keys were: no prefix, another digest."""
    return F.coalesce(cd, F.md5(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in core])))


def signal_key(name: Column, kind: Column, entity: Column, end: Column) -> Column:
    return F.sha1(F.concat_ws("|", name, kind, entity, iso_time(end)))


def spike_key(name: str, kind: str, entity: Column, now: Column) -> Column:
    return F.concat_ws("|", F.lit(name), F.lit(kind), entity, F.date_format(now, "yyyyMMddHHmmss"))
