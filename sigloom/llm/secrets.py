r"""Secret scans over a trigram inverted index.

Each rule is a regular expression.  A Boolean trigram query is derived from its parse tree:
literal runs must all occur, alternatives may.  Each block of documents gets an inverted
index from lower-cased byte trigrams to postings; a rule's query is answered by intersecting
and uniting postings, and only the documents left are matched.  A rule from which no
mandatory trigram follows (``[0-9a-f]+``) scans all of them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache
from re import _constants as op, _parser as parser

import numpy as np
from pyspark.sql import DataFrame, types as T

from sigloom.llm.common import map_rows

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WIDEST = 24  # alternatives that one literal run may branch into


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0  # code points that the group must have

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, self.flags).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

ANY = ("and",)


def _all(parts) -> tuple:
    parts = [x for x in dict.fromkeys(parts) if x != ANY]
    return parts[0] if len(parts) == 1 else ("and", *parts)


def _either(parts) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if ANY in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_runs(runs: set[str]) -> tuple:
    """What must hold if one of these literal strings occurs."""
    def one(s: str) -> tuple:
        b = s.lower().encode()
        return _all(("tri", b[i] << 16 | b[i + 1] << 8 | b[i + 2]) for i in range(len(b) - 2))

    return _either(one(s) for s in sorted(runs))


def _expand(items, runs: set[str], need: list[tuple]) -> set[str]:
    """Follow a parsed sequence: ``runs`` are the literal strings that may end here, ``need`` collects queries."""
    def cut() -> set[str]:
        need.append(_of_runs(runs))
        return {""}

    for kind, arg in items:
        options: set[str] | None = None
        if kind is op.LITERAL and arg < 128:
            options = {chr(arg)}
        elif kind is op.IN and all(k is op.LITERAL and v < 128 for k, v in arg):
            options = {chr(v) for _, v in arg}
        elif kind is op.SUBPATTERN:
            runs = _expand(arg[3], runs, need)
            continue
        elif kind is op.BRANCH:
            options, apart = set(), []
            for branch in arg[1]:
                own: list[tuple] = []
                ends = _expand(branch, {""}, own)
                apart.append(_all([*own, _of_runs(ends)]))
                options = None if own or options is None else options | ends
            if options is None:
                runs = cut()
                need.append(_either(apart))
                continue
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = arg
            own = []
            once = _expand(body, {""}, own)
            if (least, most) == (0, 1) and not own and len(once) < 3:
                options = {"", *once}
            elif least >= 1:
                more = {a + b for a in runs for b in once}
                runs = more if not own and len(more) <= _WIDEST else runs
                runs = cut()
                need.append(_all([*own, _of_runs(once)]))
                continue
        if options is None or len(options) * len(runs) > _WIDEST:
            runs = cut()
        else:
            runs = {a + b for a in runs for b in options}
    return runs


@cache
def trigram_query(pattern: str) -> tuple:
    """A query that every text with a match satisfies: ("tri", code), ("and", ...) or ("or", ...)."""
    need: list[tuple] = []
    ends = _expand(parser.parse(pattern), {""}, need)
    return _all([*need, _of_runs(ends)])


class TrigramIndex:
    """Postings of one block of documents."""

    def __init__(self, texts: list[str]):
        self.size = len(texts)
        pairs = []
        for slot, text in enumerate(texts):
            a = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8).astype(np.uint32)
            if len(a) > 2:
                codes = np.unique(a[:-2] << 16 | a[1:-1] << 8 | a[2:])
                pairs.append(codes.astype(np.uint64) << np.uint64(32) | np.uint64(slot))
        self.pairs = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)

    def postings(self, code: int) -> np.ndarray:
        a, b = np.searchsorted(self.pairs, np.array([code << 32, code + 1 << 32], np.uint64))
        return (self.pairs[a:b] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def search(self, query: tuple) -> np.ndarray:
        kind, *parts = query
        if kind == "tri":
            return self.postings(parts[0])
        if kind == "or":
            return np.unique(np.concatenate([self.search(x) for x in parts]))
        found = np.arange(self.size)
        for x in parts:
            if not len(found):
                break
            found = np.intersect1d(found, self.search(x), assume_unique=True)
        return found


def scan(texts: list[str | None], rules=RULES) -> list[list[tuple[int, str, int]]]:
    """For each text its spans (start, kind, end), by start and then kind as listed."""
    texts = [x or "" for x in texts]
    index, found = TrigramIndex(texts), [[] for _ in texts]
    for rank, rule in enumerate(rules):
        for slot in index.search(trigram_query(rule.pattern)).tolist():
            found[slot] += [(a, rank, b) for a, b in rule.spans(texts[slot])]
    return [[(a, rules[k].kind, b) for a, k, b in sorted(x)] for x in found]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None) -> DataFrame:
    """Per row the id, ``spans`` (array of kind, start, end) and, for each base kind, its count.

    A null text counts as empty and has no spans.  Rows that repeat an id stay apart; an
    empty table gives an empty result; other columns play no part.
    """
    base = [r.kind for r in BASE_RULES]

    def make():
        def run(texts):
            out = {"n_" + k: [] for k in base} | {"base_sha256": [], "spans": []}
            for spans in scan(texts, rules):
                own = [x for x in spans if x[1] in base]
                for k in base:
                    out["n_" + k].append(sum(x[1] == k for x in own))
                out["base_sha256"].append(hashlib.sha256(_joined(own).encode()).hexdigest())
                out["spans"].append(_joined(spans))
            return out

        return run

    fields = [*(T.StructField("n_" + k, T.LongType()) for k in base), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_rows(docs, make, fields, [id_col, *(also or [])], text_col, 256)


def redacted(docs: DataFrame, rules=RULES, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones merged, replaced by ``mark``; a null text stays null.

    Empty texts stay empty, repeated rows are each treated alike, and an empty table gives an empty result.
    """
    def make():
        def run(texts):
            out = []
            for text, spans in zip(texts, scan(texts, rules), strict=True):
                parts, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if spans else text)
            return {"__clean": out}

        return run

    keep = [c for c in docs.columns if c != text_col]
    done = map_rows(docs, make, [T.StructField("__clean", T.StringType())], keep, text_col, 256)
    return done.withColumnRenamed("__clean", text_col).select(*docs.columns)


def oracle_sql(rules=RULES) -> str:
    """The spans of ``documents``, for DuckDB: a match starts where what lies between and within earlier matches ends."""
    longer = {r"AKIA[A-Z0-9]+": r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]+": r"[0-9a-f]{16,}"}  # the same spans, without the short ones
    each = []
    for rank, r in enumerate(rules):
        flag = "(?i)" if r.flags & re.IGNORECASE else ""
        pattern = "'" + (flag + longer.get(r.pattern, r.pattern)).replace("'", "''") + "'"
        each.append(f"SELECT doc_id, {rank} AS r, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {pattern}) AS ps, regexp_extract_all(t, {pattern}) AS ms, regexp_extract_all(t, {pattern}, {r.group}) AS gs FROM d WHERE regexp_matches(t, {pattern})")
    base = "', '".join(r.kind for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    zeros = ", ".join(f"CAST(COALESCE(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(each)}),
 m AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f),
 s AS (SELECT doc_id, r, kind, list_sum(list_transform(ps[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, length(ms[i]) AS n FROM m WHERE length(gs[i]) >= least),
 g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, r) AS spans,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, r) FILTER (WHERE kind IN ('{base}')) AS base FROM s GROUP BY 1)
 SELECT d.doc_id, {zeros}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
