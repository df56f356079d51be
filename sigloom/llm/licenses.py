"""License scans by canonical digests.

A text becomes canonical when its copyright lines are dropped, it is lower-cased, every run
of characters other than letters and digits becomes one space, and equivalent spellings
become one.  The SHA-256 of that is joined with the digests of known licence texts.  The
same is done with each line and the known one-line notices.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigloom.llm.license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

_COPYRIGHT = r"(?im)^[^\p{L}\n]*(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[0-9]{4}|all rights reserved|<|\[)[^\n]*$"
_TITLE = r"^\s*(?:the )?(?:mit|mit-0|isc|zlib|bsd [23]-clause|0bsd|unlicense)(?: no attribution)? licen[cs]e(?: \([^)]*\))?\s*\n"
_BETWEEN = r"[^\p{L}\p{N}]+"
# Words are kept apart by two spaces, one for each of them, so that a spelling may follow itself.
_DIFFERENT = [(f" {a} ".replace(" ", "  ")[1:-1], f" {b} ".replace(" ", "  ")[1:-1]) for a, b in SPELLINGS if a != b]
MOST_KNOWN = 100_000  # rows of a known table that is broadcast


def _once(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """``steps`` one after the other, each evaluated once however often the next one names it."""
    held = F.array(c)
    for step in steps:
        held = F.transform(held, step)
    return F.get(held, 0)


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; null counts as empty."""
    def without_copyright(t: Column) -> Column:
        # Few texts have a line to look for.
        low = F.lower(t)
        return F.when(low.contains("copyright") | low.contains("(c)") | t.contains("©"), F.regexp_replace(t, _COPYRIGHT, "")).otherwise(t)

    def spelled(t: Column) -> Column:
        # One pass finds out whether any spelling is there; few texts pay for the replacements.
        fixed = t
        for x, y in _DIFFERENT:
            fixed = F.replace(fixed, F.lit(x), F.lit(y))
        return F.when(t.rlike(" (?:" + "|".join(x[1:] for x, _ in _DIFFERENT) + ")"), fixed).otherwise(t)

    lines = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return _once(
        lines,
        without_copyright,
        lambda t: F.regexp_replace(F.lower(t), _TITLE, ""),
        lambda t: F.concat(F.lit("  "), F.regexp_replace(t, _BETWEEN, "  "), F.lit("  ")),
        spelled,
        lambda t: F.replace(F.trim(t), F.lit("  "), F.lit(" ")),
    )


def first_words(forms: list[str]) -> set[str] | None:
    """The words that a line whose canonical form is one of ``forms`` may start with, before its spellings are mended; None for any."""
    if not all(forms):
        return None
    words = {x.split(" ")[0] for x in forms}
    while more := {a.split()[0] for a, b in _DIFFERENT if b.split()[0] in words} - words:
        words |= more
    return words


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, entries: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license) of (license, text) and (license, digest): a digest that several share has the first name in order.

    Broadcast up to MOST_KNOWN rows, shuffled beyond.
    """
    rows = spark.createDataFrame(list(entries), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    rows = rows.union(spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license"))
    found = rows.groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(found) if len(entries) + len(digests) <= MOST_KNOWN else found


def license_scan(docs: DataFrame, texts=TEXTS, notices=NOTICES, digests=DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text_digest, license (of the whole text, or null), notices (sorted names, comma-joined,
    of lines that are known notices, '' if none).

    The known tables are arguments or the ones of this package.  Null and empty texts have the digest of the
    empty text, which is no licence.  Rows that repeat an id stay apart.  An empty table gives an empty result.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    rows = docs.select(F.col(id_col), F.xxhash64(text).alias("__salt"), digest(text).alias("text_digest"))
    # Only a line that starts as a notice does can be one: the others aren't made canonical.
    forms = [r[0] for r in spark.createDataFrame(list(notices), "license string, text string").select(canonical(F.col("text"))).distinct().collect()]
    words = first_words(forms)
    each = F.split(F.coalesce(text, F.lit("")), "\r\n?|\n")
    if words is not None:
        start = r"^[^\p{L}\p{N}]*(?:" + "|".join(map(re.escape, sorted(words) or ["$."])) + r")(?![\p{L}\p{N}])"
        each = F.filter(each, lambda x: F.lower(x).rlike(start))
    lines = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__s"), F.explode(each).alias("line"))
    hits = lines.select("__id", "__s", digest(F.col("line")).alias("digest")).join(known(spark, notices), "digest")
    # Few rows have a line that is a notice; only their names are grouped.
    found = hits.groupBy("__id", "__s").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = known(spark, texts, digests).withColumnRenamed("digest", "text_digest")
    joined = rows.join(whole, "text_digest", "left").join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__salt") == F.col("__s")), "left")
    return joined.select(id_col, "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql() -> str:
    """The scan of ``documents`` with this package's tables, for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"regexp_replace(regexp_replace(COALESCE(@, ''), '\\r\\n?', chr(10), 'g'), {quote(_COPYRIGHT)}, '', 'g')"
    form = f"'  ' || regexp_replace(regexp_replace(lower({form}), {quote(_TITLE)}, ''), {quote(_BETWEEN)}, '  ', 'g') || '  '"
    for a, b in _DIFFERENT:
        form = f"replace({form}, {quote(a)}, {quote(b)})"
    of = lambda column: f"sha256(replace(trim({form}), '  ', ' '))".replace("@", column)
    rows = lambda x: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in x)
    known = lambda x: "SELECT l, " + of("t") + f" AS d FROM (VALUES {rows(x)}) x(l, t)"
    return f"""WITH whole AS (SELECT d, min(l) AS l FROM ({known(TEXTS)} UNION ALL SELECT * FROM (VALUES {rows(DIGESTS)}) y(l, d)) GROUP BY 1), notice AS (SELECT d, min(l) AS l FROM ({known(NOTICES)}) GROUP BY 1),
 docs AS (SELECT doc_id, text, {of("text")} AS text_digest FROM documents),
 lines AS (SELECT doc_id, unnest(string_split(regexp_replace(COALESCE(text, ''), '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents),
 found AS (SELECT doc_id, string_agg(DISTINCT notice.l, ',' ORDER BY notice.l) AS notices FROM lines JOIN notice ON notice.d = {of("line")} GROUP BY 1)
 SELECT docs.doc_id, text_digest, whole.l AS license, COALESCE(notices, '') AS notices FROM docs LEFT JOIN whole ON whole.d = text_digest LEFT JOIN found ON found.doc_id = docs.doc_id"""
