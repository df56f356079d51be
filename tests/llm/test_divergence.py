import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import divergence
from sigloom.llm.queries import op12_divergence

DOCS = "doc_id long, text string, lang string, source string"


def brute_force(rows, least, top):
    """All shares of all groups, in whole numbers."""
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        docs[lang].update(set(found))
        n[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-(p[s][t] - q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return out


def rows_of(n_docs, n_sources, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "And", "OF", "Ärger", "naïve"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n_docs):
        s = int(rng.integers(n_sources))
        own = [words[(s * 7 + int(k)) % len(words)] for k in rng.zipf(1.4, 30) % 40]
        rows.append((i, " ".join([*own, *words[:3], "x1y2-z_q"]), ["en", "de"][i % 7 == 0], f"s{s}"))
    return rows + [(None, None, None, None), (1, "", "", None), (2, "the", None, ""), (3, None, "en", "bare"), (4, "12 345", "zz", "a"), (5, "?", "zz", "b"), (6, "the " * 400_000, "en", "s1")] + rows[:5]


@pytest.mark.parametrize(("n_docs", "n_sources", "least", "small"), [(600, 9, 2, 1), (900, 150, 3, 2), (40, 1, 30, 4)])
def test_audit_matches_brute_force(spark, n_docs, n_sources, least, small, monkeypatch):
    rows = rows_of(n_docs, n_sources, n_docs)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit("x"), "rank": F.lit(1), "p": F.lit(2)}).repartition(3)
    got = divergence.audit(docs, least, top_terms=12, tile_terms=30 * small, values=small)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute_force(rows, least, 12)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {x[2] for x in want} == {"pair", "term"}


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_parts_add_up():
    rng = np.random.default_rng(3)
    p, m, others = rng.integers(10, 90, 50), rng.integers(1, 5, 50), rng.integers(1, 100, 20)
    want = [sum(int(k) * (abs(int(x) - int(y)) - abs(10 - int(y))) for x, k in zip(p, m, strict=True)) for y in others]
    assert divergence.own_terms(p, m, 10, others).tolist() == want


def test_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Ab cdefghijkl mn äöüäöüäöü x,y".encode()
    parts = list(divergence.pieces(text))
    assert b"".join(parts) == text.lower() and len(parts) > 2
    assert [t for x in parts for t in divergence._TERM.findall(x)] == divergence._TERM.findall(text.lower())


def test_counts_pass_64_bits(spark):
    """Shares of counts that times the scale don't fit a long."""
    row = spark.range(1).selectExpr("CAST(3000000000000 AS BIGINT) AS n", "CAST(9000000000001 AS BIGINT) AS total", "7L AS v").selectExpr(divergence._share("n") + " AS p").first()
    assert row.p == 1 + 10**9 * (3 * 10**12 + 5) // (9 * 10**12 + 1 + 35)


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.sql(divergence.oracle_sql())
    got = op12_divergence(spark, d)
    assert got.columns == want.columns
    want = want.fetchall()
    assert len(want) > 2000 and sorted(map(tuple, got.collect())) == sorted(want)
