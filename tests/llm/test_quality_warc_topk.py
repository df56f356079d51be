import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from sigloom.llm import quality, topk, warc

DOCS = "doc_id long, text string, lang string, source string"
PAGES = "page_id long, url string, html string"


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("score", F.lit(3)).withColumn("y", F.lit(0))
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumn("x", F.lit(0))
    got = quality.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert len(good) > 500 and len(bad) > 80
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_discriminant_matches_a_plain_density():
    rng = np.random.default_rng(5)
    d = quality.N_FEATURES
    x = {0: rng.normal(0, 1, (300, d)), 1: rng.normal(1, 2, (500, d)) @ rng.normal(0, 0.4, (d, d))}
    model = quality.Discriminant({y: (float(len(v)), v.sum(axis=0), v.T @ v) for y, v in x.items()})
    both = np.concatenate([x[0], x[1]])
    z = {y: (v - both.mean(axis=0)) / both.std(axis=0) for y, v in x.items()}
    pooled = (300 * np.cov(z[0].T, bias=True) + 500 * np.cov(z[1].T, bias=True)) / 800
    log = []
    for y, n in ((0, 300), (1, 500)):
        s = (1 - quality.POOLED) * np.cov(z[y].T, bias=True) + quality.POOLED * pooled
        s = (1 - quality.RIDGE) * s + quality.RIDGE * np.trace(s) / d * np.eye(d)
        e = (both - both.mean(axis=0)) / both.std(axis=0) - z[y].mean(axis=0)
        log.append(np.log(n / 800) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e))
    assert np.allclose(model.score(both), 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))))


def plain_statistics(raw):
    """The statistics by loops over characters and words."""
    import math

    if not raw:
        return [0.0] * quality.N_FEATURES
    n = len(raw)
    of = lambda test: sum(1 for b in raw if test(b))
    upper, lower, digits, high = of(lambda b: 65 <= b <= 90), of(lambda b: 97 <= b <= 122), of(lambda b: 48 <= b <= 57), of(lambda b: b > 127)
    space, symbols = of(lambda b: b in b" \t\n\v\f\r"), of(lambda b: b in b"#$%&*@^~<>{}[]\\=_+")
    words, lines, share = raw.split(), raw.split(b"\n"), [raw.count(b) / n for b in set(raw)]
    m = max(1, len(words))
    return [
        math.log(1 + n), math.log(1 + len(words)), math.log(1 + (n - space) / m), math.sqrt(upper / (upper + lower + 1)), math.sqrt(digits / n), math.sqrt(symbols / n),
        math.sqrt(raw.count(b"!") / n), math.sqrt(raw.count(b"|") / n), math.sqrt((n - upper - lower - digits - high - space) / n), math.log(1 + len(set(words))) / math.log(1 + m),
        1 - len(set(lines)) / len(lines), math.log(1 + n / len(lines)), -sum(x * math.log(x) for x in share), sum(1 for w in words if len(w) <= 3) / m, math.sqrt(high / n),
        1 - len({(a, b) for a, b in zip(words, words[1:])}) / max(1, len(words) - 1),
    ]


def test_statistics_and_moments_match_plain_ones(spark, sf):
    import zlib

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for raw in [*list(texts.values())[:60], b"", b" ", b"\n\n", b"a", "é!|{".encode(), b"x\ty\vz"]:
        assert np.allclose(quality.statistics(raw), plain_statistics(raw))
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in texts}
    x = quality.features(docs)
    split = {r.doc_id: r.held_out for r in x.collect()}
    assert split == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in texts}
    got = quality.moments(x.where("NOT held_out").join(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id"))
    for y in (0, 1):
        own = np.array([plain_statistics(texts[k]) for k, v in known.items() if v == y])
        assert got[y][0] == len(own) and np.allclose(got[y][1], own.sum(axis=0)) and np.allclose(got[y][2], own.T @ own)


def test_quality_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "x"), (2, "again " * 9000, "en", "x"), (None, "é", None, None)]
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, none).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, None, 1), (2, 7, 0), (None, 1, 1)], none.schema)
    assert all(0 < r.score < 1 for r in quality.quality_scores(docs, some).collect())
    assert quality.quality_scores(docs.limit(0), some).count() == 0


def plain_roles(rows):
    first = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, page), page)
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        r = first.get(b, page)
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if r != page else "response", r if r != page else None))
    return sorted(out)


def test_warc_round_trip(spark, sf):
    own = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    long = "é" * 300_000
    own += [(1000 + i, "http://a b\r\nX: y", "<p>" + "same" * 40) for i in range(60)]
    own += [(2000, None, None), (2001, "u", ""), (2002, "u", "x" * 99), (2003, "u", "x" * 99), (2004, "u", long), (1, "u", long + "!"), (2005, "u", "\r\n\r\nWARC/1.0\r\n\x1f"), (2006, "u", "x" * 100), (2007, "v", "x" * 100)]
    own = [x for i, x in enumerate(own) if x[0] != 1 or i >= 50 or x[2] is None or True]
    seen, rows = set(), []
    for x in own:
        if x[0] not in seen:
            seen.add(x[0])
            rows.append(x)
    pages = spark.createDataFrame(rows, PAGES).withColumn("refers_to", F.lit("clash")).withColumn("payload", F.lit(0)).repartition(3)
    for size in (1000, 1 << 20):
        got = warc.round_trip(spark, pages, size)
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.drop("payload").collect()) == plain_roles(rows)
        bodies = {r.page_id: r.payload for r in got.collect()}
        assert all(bodies[p] is None or bodies[p] == (h or "").encode() for p, _, h in rows)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_records_across_buffers(spark):
    import random

    rng = random.Random(6)
    rows = [(i, "u", "".join(rng.choices("abcdefghijklmnop <>é", k=rng.randrange(3000, 60_000)))) for i in range(400)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    want = {i: h.encode() for i, _, h in rows}
    for size in (warc.RANGE_BYTES, 300_000):
        assert {r.page_id: bytes(r.payload) for r in warc.round_trip(spark, pages, size).collect()} == want


def test_warc_null_and_repeated_ids(spark):
    body = "b" * 200
    rows = [(5, "u", body), (5, "u", body), (None, "u", body), (9, "u", body)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("5", "response", None)] * 2 + [("9", "revisit", 5), ("None", "revisit", 5)])


def stored_member(data):
    import zlib

    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_all(spark, path, step):
    manifest = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    return {r.page_id: bytes(r.payload) for r in warc.read_archives(manifest, step).collect()}


@pytest.mark.parametrize("step", [97, 5000])
def test_ranges_pass_over_false_magic(spark, tmp_path, step):
    payloads = {i: b"\x1f\x8b\x08" * i + bytes(range(256)) + gzip.compress(b"not a record") for i in range(12)}
    p = Path(tmp_path) / "a.warc.gz"
    p.write_bytes(b"".join(stored_member(warc.encode(i, "http://x", x, None)) for i, x in payloads.items()))
    assert read_all(spark, p, step) == payloads


@pytest.mark.parametrize("step", [64, 700, 100_000])
def test_records_within_payloads_are_none(spark, tmp_path, step):
    inner = b"".join(stored_member(warc.encode(900 + i, "http://x", b"inner %d " % i * 20, None)) for i in range(5))
    payloads = {1: b"before", 2: b"a" + inner, 3: inner + b"tail", 4: inner, 5: b"after" * 50}
    p = Path(tmp_path) / "a.warc.gz"
    p.write_bytes(b"".join(stored_member(warc.encode(i, "http://x", x, None)) for i, x in payloads.items()))
    assert read_all(spark, p, step) == payloads


def test_damage_is_an_error(spark, tmp_path):
    p = Path(tmp_path) / "a.warc.gz"
    members = [stored_member(warc.encode(i, "http://x", b"some payload %d" % i * 9, None)) for i in range(6)]
    for broken in (b"".join(members)[:-30], b"".join([*members[:3], b"???", *members[3:]]), b"".join(members).replace(b"payload 4", b"PAYLOAD 4")):
        p.write_bytes(broken)
        with pytest.raises(Exception, match="no record at|breaks off|damaged"):
            read_all(spark, p, 300)


def plain_top(vectors, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], np.int64)
    out = []
    for i in ids:
        if i % 20 == 0:
            s = m @ np.array(vectors[i], np.int64)
            best = sorted((-int(x), j) for x, j in zip(s, ids) if j != i)[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk_matches_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("shard", F.lit(1)).withColumn("v", F.lit("clash"))
    vectors = {r.vec_id: [int(np.floor(64 * float(x))) for x in r.embedding] for r in table.collect()}
    for rows in (8192, 90):
        got = topk.top_k(table, F.col("vec_id") % 20 == 0, 20, shard_rows=rows, query_rows=4)
        assert sorted(map(tuple, got.collect())) == plain_top(vectors, 20)


def test_topk_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3), -1.0]) for i in range(0, 130)] + [(200, None), (220, [nan, 1.0]), (240, [1.0, None, 1.0]), (260, [inf]), (None, [1.0]), (7, [1.0, 1.0, -1.0]), (280, []), (300, [5e7, -5e7, 1e8])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clean = {i: [64, 64 * (i % 3), -64] for i in range(130)} | {280: [0, 0, 0], 300: [3200000000, -3200000000, 6400000000]}
    for size in (8192, 40):
        got = topk.top_k(table, F.col("vec_id") % 20 == 0, 20, shard_rows=size, query_rows=3)
        assert sorted(map(tuple, got.collect())) == plain_top(clean, 20)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 0 + 2), (2, 1)] or len(few) == 2


def test_queries_visit_only_cells_that_may_hold_better(spark, tmp_path):
    """Of clustered vectors each moves once, and a query goes to few of the shards; equal ones fill shards of their own."""
    rng = np.random.default_rng(8)
    heart = rng.normal(0, 3, (16, 6))
    rows = [(i, [float(x) for x in heart[i % 16] + rng.normal(0, 0.05, 6)]) for i in range(3000)] + [(5000 + i, [0.5] * 6) for i in range(1000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    asks = F.col("vec_id") % 20 == 0
    dealt, home = topk.planted(table, asks, 20, 100, str(tmp_path))
    trees = home.where("path IS NOT NULL").count()
    assert dealt.count() == 4000 and 40 <= trees <= 90
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] <= 250
    queries, visits = dealt.where(asks).count(), topk.visits(dealt, home, asks, 20).count()
    assert visits < 0.35 * queries * trees
    vectors = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = topk.top_k(table, asks, 20, shard_rows=100)
    assert sorted(map(tuple, got.collect())) == plain_top(vectors, 20)


def test_packed_vectors():
    for v in ([0], [127, -128], [128, 0], [-129], [2**31, 1], [-(2**40)], [], [32767, -32768], [32768]):
        x = np.array(v, np.int64)
        assert topk._unpacked([topk._packed(x)]).tolist() == [v]
