"""How the sources of each language differ in words: distances of all pairs, and the terms that mark a source.

Terms are runs of letters A to Z, lower-cased, and of characters beyond ASCII.  A language keeps the terms that
enough of its documents hold.  A group, all documents of a language and a source, gives a kept term the share
p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)), so p0 where it doesn't hold the term.

The distance of two groups is the sum of |p - q| over all kept terms, in whole numbers.  It is added up in parts:

* V * |p0 - q0|, as if neither held any term;
* terms that many groups hold (a quarter of the language's) fill dense tiles of ``BLOCK`` by ``BLOCK`` groups and about
  ``TERMS`` terms in numpy; a tile gives what it has beyond the first part;
* of all other terms each group's own ones give what they add against groups without them, which depends on the other
  group's q0 alone, so a histogram of p answers for all terms at once;
* and a term that two groups share is put right by a correction for each pair of its postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sigloom.llm.common import stored

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
DENSE = 4  # a term is dense if this many times its groups are all groups
BLOCK = 128  # groups a side of a tile
TERMS = 1024  # of a tile, about
VALUES = 65_536  # of a histogram that are added in one place
HELD = 400_000  # counts of a task before they are passed on
PIECE = 1 << 20  # bytes split into terms at a time
PAIRS = 1 << 20  # sums of pairs of a task before they are passed on

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def pieces(text: bytes) -> Iterator[bytes]:
    """Lower-cased parts of a text, cut where no term is."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and (text[end] >= 0x80 or chr(text[end]).isalpha()):
            end += 1
        yield text[at:end].lower()
        at = end
    yield text[at:].lower()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents; a group also has a row without a term."""
    keyed = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    names = ["lang", "source", "term", "n", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string())]
                columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((lang, source, None, 0, 0), (pa.string(),) * 3 + (pa.int64(),) * 2, strict=True)], names=names)
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for part in pieces(text):
                    terms = _TERM.findall(part)
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    rows = keyed.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(n: str) -> str:
    """p of a count; decimals, as counts times SCALE pass 64 bits."""
    return f"1 + (CAST({n} + {SMOOTHING} AS DECIMAL(20, 0)) * {SCALE}) DIV (total + {SMOOTHING} * v)"


def _reduced(lang: np.ndarray, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums by (lang, a, b); lang is a code."""
    order = np.lexsort((b, a, lang))
    lang, a, b, v = (x[order] for x in (lang, a, b, v))
    first = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return lang[first], a[first], b[first], np.add.reduceat(v, first) if len(first) else v


_SUMS = "lang string, a long, b long, v long"


def corrections(postings: DataFrame) -> DataFrame:
    """(lang, a, b, v) of (lang, term, holders): what pairs of a term's groups take back.

    Holders are (rank, p, p0), in the order of rank.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            held = [_reduced(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if last or len(held[0][0]) >= PAIRS:
                known = pa.array(list(names), pa.string())
                lang, *rest = held[0]
                yield pa.RecordBatch.from_arrays([known.take(pa.array(lang)), *map(pa.array, rest)], names=["lang", "a", "b", "v"])
                held = []

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                code = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()])
                lists = part.column(1)
                ends = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                rank, p, p0 = (x.to_numpy() for x in lists.flatten().flatten())
                end, code = np.repeat(np.cumsum(ends), ends), np.repeat(code, ends)
                i = np.arange(len(rank))
                for step in range(1, int(ends.max(initial=0))):
                    i = i[i + step < end[i]]
                    j = i + step
                    v = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                    held.append((code[i], rank[i], rank[j], v))
                    if sum(len(x[0]) for x in held) >= 2 * PAIRS:
                        yield from out(False)
        if held:
            yield from out(True)

    return postings.select("lang", "holders").mapInArrow(run, _SUMS)


def own_terms(values: np.ndarray, times: np.ndarray, p0: int, others: np.ndarray) -> np.ndarray:
    """For each q0 of ``others`` the sum of |p - q0| - |p0 - q0| over values p, each so many times."""
    order = np.argsort(values)
    values, times = values[order], times[order]
    count, total = np.append(0, np.cumsum(times)), np.append(0, np.cumsum(times * values))
    below = np.searchsorted(values, others)
    apart = others * count[below] - total[below] + (total[-1] - total[below]) - others * (count[-1] - count[below])
    return apart - count[-1] * np.abs(p0 - others)


def _own_rows(histograms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, a, b, v): of each histogram (p0, v, values, times) against each block of groups, V * |p0 - q0| with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lang, rank, p0, v, values, times, ranks, others = (c[at].as_py() for c in batch.columns)
                ranks, others = np.array(ranks, np.int64), np.array(others, np.int64)
                made = own_terms(np.array(values, np.int64), np.array(times, np.int64), p0, others)
                made += np.where(ranks > rank, v * np.abs(p0 - others), 0)  # once a pair
                ok = ranks != rank
                a, b = np.minimum(ranks[ok], rank), np.maximum(ranks[ok], rank)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(made[ok])], names=["lang", "a", "b", "v"])

    return histograms.join(blocks, "lang").select("lang", "rank", "p0", "v", "values", "times", "ranks", "others").mapInArrow(run, _SUMS)


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the pairs of a tile's groups have beyond |p0 - q0| a term; rows without a term name a group."""
    groups = pdf[pdf["term"].isna()].drop_duplicates("rank").sort_values("rank")
    cells = pdf[pdf["term"].notna()]
    ranks, p0, side = groups["rank"].to_numpy(), groups["p0"].to_numpy(), (groups["rank"] // BLOCK).to_numpy()
    code, terms = pd.factorize(cells["term"])
    p = np.repeat(p0[:, None], len(terms), axis=1)
    p[np.searchsorted(ranks, cells["rank"].to_numpy()), code] = cells["p"].to_numpy()
    low, high = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    out = []
    for a in np.flatnonzero(side == low):
        b = np.flatnonzero((side == high) & (ranks > ranks[a]))
        v = np.abs(p[b] - p[a]).sum(axis=1) - len(terms) * np.abs(p0[b] - p0[a])
        out.append(pd.DataFrame({"a": ranks[a], "b": ranks[b], "v": v}))
    sums = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "v": []})
    return sums.assign(lang=pdf["lang"].iloc[0])[["lang", "a", "b", "v"]]


def dense(cells: DataFrame, groups: DataFrame, terms: int, size: int = TERMS) -> DataFrame:
    """(lang, a, b, v) of the cells (lang, term, rank, p) of dense terms, tile by tile."""
    lane = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-terms // size))))
    block = F.floor(F.col("rank") / BLOCK).cast("int")
    own, other = F.col("own"), F.col("other")
    sides = F.explode(F.sequence(F.lit(0), F.col("last_block"))).alias("other")
    names = groups.select("lang", "rank", "p0", "last_block")
    spread = cells.withColumn("lane", lane)
    lanes = spread.select("lang", "lane").distinct()
    both = spread.select("lang", "lane", "term", "rank", "p", "p0", "last_block").unionByName(lanes.join(names, "lang").withColumns({"term": F.lit(None).cast("string"), "p": F.col("p0")}))
    dealt = both.select("lang", "lane", "term", "rank", "p", "p0", block.alias("own"), sides).select("lang", "lane", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "term", "rank", "p", "p0")
    return dealt.groupBy("lang", "lane", "i", "j").applyInPandas(_tile, _SUMS)


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, tile_terms: int = TERMS, values: int = VALUES) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text).

    Part ``pair`` lists for each group all other sources of its language, the most distant first; part ``term`` its
    terms of a greater share than in the language as a whole, at most ``top_terms``.  Ties go by the item's bytes.
    A null text, language or source counts as an empty one.  A group without terms has pairs all the same; without kept terms
    all distances are zero.  Rows that repeat others count each, ids aren't read.  An empty table gives an empty result.
    """
    counts = stored(term_counts(docs), "terms")
    known = counts.where("term IS NOT NULL")
    kept = known.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n_lang"), F.count("*").alias("holders")).where(F.col("d") >= least_documents)
    cells = stored(known.select("lang", "source", "term", "n").join(kept.drop("d"), ["lang", "term"]), "cells")
    # A row a term, from any one of its groups.
    langs = cells.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.countDistinct("term").alias("v"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")
    named = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "total_lang", "v"])
    p0 = F.when(F.col("v") > 0, F.expr(_share("0"))).otherwise(0)
    ranked = named.withColumns({"rank": (F.row_number().over(order) - 1).cast("long"), "n_groups": F.count("*").over(Window.partitionBy("lang")), "p0": p0})
    groups = stored(ranked.withColumn("last_block", F.floor((F.col("n_groups") - 1) / BLOCK).cast("int")), "groups")

    full = cells.join(groups, ["lang", "source"]).withColumns({"p": F.expr(_share("n")), "q": F.expr(_share("n_lang").replace("total", "total_lang"))})
    full = stored(full.select("lang", "source", "term", "rank", "p", "q", "p0", "last_block", (F.col("holders") * DENSE >= F.col("n_groups")).alias("many")), "shares")
    few = full.where("NOT many")
    dense_terms = full.where("many").select("lang", "term").distinct().groupBy("lang").count().agg(F.max("count")).first()[0] or 0

    postings = few.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("rank", "p", "p0"))).alias("holders")).where(F.size("holders") > 1)
    counted = few.groupBy("lang", "rank", "p0", "p").agg(F.count("*").alias("m"))
    parts = counted.groupBy("lang", "rank").agg(F.ceil(F.count("*") / values).alias("parts"))
    counted = counted.join(parts, ["lang", "rank"]).groupBy("lang", "rank", "p0", F.pmod(F.xxhash64("p"), "parts")).agg(F.collect_list(F.struct("p", "m")).alias("x"))
    none = F.array().cast("array<bigint>")
    # A row for each group, for V * |p0 - q0|, and one for each part of its histogram.
    base = groups.select("lang", "rank", "p0", "v", none.alias("values"), none.alias("times"))
    histograms = base.union(counted.select("lang", "rank", "p0", F.lit(0), "x.p", "x.m"))
    blocks = groups.groupBy("lang", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "p0"))).alias("x")).select("lang", F.col("x.rank").alias("ranks"), F.col("x.p0").alias("others"))

    sums = _own_rows(histograms, blocks).union(corrections(postings)).union(dense(full.where("many"), groups, dense_terms, tile_terms))
    sums = stored(sums.groupBy("lang", "a", "b").agg(F.sum("v").alias("value")), "distances")
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("z")
    of = lambda r, name: groups.select("lang", F.col("rank").alias(r), F.col("source").alias(name))
    pairs = sums.select("lang", both, "value").select("lang", "z.x", "z.y", "value").join(of("x", "source"), ["lang", "x"]).join(of("y", "item"), ["lang", "y"])
    terms = full.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(best)
    listed = terms.withColumn("rank", place).where(F.col("rank") <= top_terms)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place).unionByName(listed)


def oracle_sql() -> str:
    """Counts, shares and sums of ``documents`` for DuckDB, each group with all terms of its language."""
    return f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
 g AS (SELECT DISTINCT lang, source FROM d),
 k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCUMENTS}),
 l AS (SELECT lang, term, 1 + (CAST({SCALE} AS HUGEINT) * (n + {SMOOTHING})) // (sum(n) OVER (PARTITION BY lang) + {SMOOTHING} * count(*) OVER (PARTITION BY lang)) AS q FROM k),
 c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
 a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT lang, source, term, n, 1 + (CAST({SCALE} AS HUGEINT) * (n + {SMOOTHING})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTHING} * count(*) OVER (PARTITION BY lang, source)) AS p FROM a),
 s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
 r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
   UNION ALL SELECT p.lang, source, 'term', p.term, p - q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM r WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
