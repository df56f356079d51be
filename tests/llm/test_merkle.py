import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sigloom.llm import merkle
from sigloom.llm.queries import op11_merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    told = ["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return H(*told)


def plain_tree(leaves):
    """The root, and for each leaf its siblings (before, after) a level."""
    found, at, row = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(row) > 1:
        for k, i in enumerate(at):
            a = i // 8 * 8
            found[k].append((row[a:i], row[i + 1 : a + 8]))
            at[k] = i // 8
        row = [H(*row[i : i + 8]) for i in range(0, len(row), 8)]
    return row[0], found


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {g: plain_tree([plain_leaf(r) for r in groups[g]]) for g in order}
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, own in zip(groups[g], trees[g][1], strict=True):
            leaf = plain_leaf(r)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            low = None if r["text"] is None else "".join(x.lower() if "A" <= x <= "Z" else x for x in r["text"])
            h = plain_leaf(r | {"text": low}) if bad else leaf
            for before, after in own + top:
                h = H(*before, h, *after)
            out.append((r["doc_id"], leaf, trees[g][0], root, H(*[x for b, a in own + top for x in b + a]), h, h == root))
    return out


def rows_of(n):
    made = [{"doc_id": i * 7 % n, "text": f"Text {i} Ä" if i % 5 else "", "lang": ["en", "de", "zh", None, ""][i % 13 % 5], "source": f"s{i % 3}" if i % 4 else None, "n_chars": i if i % 6 else None} for i in range(n)]
    odd = [{"doc_id": None, "text": x, "lang": "en", "source": "s", "n_chars": 1} for x in ("A", "B", None, "A")]
    return made + odd + made[:3] + [{"doc_id": 1, "text": "other", "lang": "en", "source": "s", "n_chars": 1}, {"doc_id": 10**12, "text": "X" * 300_000, "lang": "alone", "source": None, "n_chars": None}]


def key(x):
    return tuple(map(str, x))


@pytest.mark.parametrize(("n", "cut", "partitions"), [(700, 1, 9), (700, 2, 40), (90, 4, None), (1, 2, 2)])
def test_proofs_match_brute_force(spark, n, cut, partitions):
    rows = rows_of(n)
    docs = spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCS.split(", ")) for r in rows], DOCS).repartition(5)
    docs = docs.withColumns({"g": F.lit("x"), "leaf": F.lit(1), "idx": F.lit(2), "payload": F.lit(3)})
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.proofs(docs, altered={"text": lower}, where=where, cut=cut, partitions=partitions).collect()
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(brute_force(rows), key=key)
    for r in got:  # the path itself leads from the leaf to the root
        path = [x.encode() for x in r.path]
        assert merkle.folded(r.leaf.encode(), path).decode() == r.root
        assert H(*r.path) == r.proof_sha256


@pytest.mark.parametrize(("n", "langs", "cut"), [(9, 1, 1), (65, 1, 2), (4097, 1, 4), (75, 9, 1)])
def test_last_runs_of_one(spark, n, langs, cut):
    rows = [{"doc_id": i, "text": f"t{i}", "lang": f"l{i % langs}", "source": "s", "n_chars": 1} for i in range(n)]
    docs = spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCS.split(", ")) for r in rows], DOCS)
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.proofs(docs, altered={"text": F.lower("text")}, where=where, cut=cut, partitions=1).collect()
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(brute_force(rows), key=key)
    assert all(r.verified and merkle.folded(r.leaf.encode(), [x.encode() for x in r.path]).decode() == r.root for r in got)


def test_manifest_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "b", None, "s", 1), (3, "c", "", None, None)], DOCS)
    got = {r.lang: r for r in merkle.manifest(docs).collect()}
    assert {k: r.n_leaves for k, r in got.items()} == {"en": 1, None: 1, "": 1}
    assert len({r.root for r in got.values()}) == 1 and len({r.subroot for r in got.values()}) == 3
    assert got["en"].root == H(*[got[x].subroot for x in (None, "", "en")])
    assert merkle.proofs(docs.limit(0)).collect() == [] and merkle.manifest(docs.limit(0)).collect() == []


def test_any_change_is_seen(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(70)], DOCS)
    root = merkle.manifest(docs).first().root
    assert merkle.manifest(docs.repartition(7)).first().root == root
    for other in (docs.where("doc_id <> 69"), docs.union(docs.limit(1)), docs.withColumn("text", F.when(F.col("doc_id") == 5, "T5").otherwise(F.col("text"))), docs.withColumn("source", F.lit(None).cast("string"))):
        assert merkle.manifest(other).first().root != root


def test_subtrees_cover_the_range_once():
    leaves = [H(str(i)).encode() for i in range(200)]
    for n in (1, 7, 8, 9, 64, 65, 130, 200):
        for a in range(0, n, 11):
            for b in (a + 1, min(n, a + 9), n):
                if b > n or a >= b:
                    continue
                covered = []
                for level, i, node in merkle.subtrees(a, leaves[a:b], b == n, 5):
                    own = range(i * 8**level, min((i + 1) * 8**level, n))
                    covered += own
                    row = leaves[own.start : own.stop]
                    for _ in range(level):
                        row = [merkle.digest(row[k : k + 8]) for k in range(0, len(row), 8)]
                    assert row == [node]
                assert sorted(covered) == list(range(a, b))


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.sql(merkle.oracle_sql())
    got = op11_merkle(spark, d)
    assert got.columns == want.columns
    want = want.fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 1000 and sorted(rows, key=key) == sorted(want, key=key)
    assert 0 < sum(r[6] for r in rows) < 1000
