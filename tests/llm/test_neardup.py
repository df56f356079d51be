import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import neardup, simhash

DOCS = "doc_id long, text string, lang string, source string"


class Union:
    def __init__(self, keys):
        self.root = {k: k for k in keys}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def link(self, a, b):
        x, y = sorted((self.find(a), self.find(b)))
        self.root[y] = x


def plain_groups(texts, least=0.8):
    """Groups by all pairs of shingle sets, and the pairs of different sets."""
    grams = {k: frozenset(simhash.shingles(t.encode(), 5)) for k, t in texts.items()}
    ids, u, pairs = sorted(grams), Union(grams), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, all_ = len(grams[a] & grams[b]), len(grams[a] | grams[b])
            if grams[a] == grams[b] or both >= least * all_ - 1e-9:
                u.link(a, b)
                if grams[a] != grams[b]:
                    pairs.append((a, b))
    return u, pairs


def test_layout_holds_load_and_recall():
    for n in (2, 1000, 50_000, 1_000_000, 10**10):
        bits, segments = neardup.layout(n)
        assert neardup.load(n) <= max(9, 1 + bits / 2) and 1 - (1 - neardup.meeting(bits)) ** segments >= neardup.RECALL
    assert neardup.layout(10**10)[1] < 12 * neardup.layout(100_000)[1]


def meet(a, b):
    """Whether two prints share a bucket and agree in the check words."""
    (_, _, x, s, _), (_, _, y, t, _) = a, b
    apart = [(i ^ j).bit_count() for i, j in zip(s, t)]
    bucket = any(d < 2 or (d == 2 and (i & ~j) and (j & ~i)) for d, i, j in zip(apart, s, t))
    return bucket and sum(((i ^ j) & 2**64 - 1).bit_count() for i, j in zip(x, y)) <= neardup.CHECK


def test_segments_of_similar_sets_meet():
    rng, met = np.random.default_rng(4), 0
    bits, segments = neardup.layout(200_000)
    for _ in range(150):
        own = rng.integers(0, 2**64, 360, dtype=np.uint64)
        a, b = np.sort(own), np.sort(np.concatenate([own[:320], rng.integers(0, 2**64, 40, dtype=np.uint64)]))  # 320 of 400
        met += meet(*(neardup.node_print(z, bits, segments) for z in (a, b)))
    assert met >= 0.88 * 150


def chains(rng, n):
    """Texts of which each is like the next and the ends are not alike."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(n):
        w = [word() for _ in range(260)]
        for step in range(4):
            out.append(" ".join(w))
            for _ in range(3):
                w[rng.randrange(len(w))] = word()
    return out


def grouped_as(spark, docs):
    """{doc: its group}, by the documents that share a node."""
    found = neardup.grouped(docs).select("x.id", "component").collect()
    return {r.id: r.component for r in found}


def test_groups_match_brute_force(spark):
    """No pair that meets is lost, whatever the group; few at 0.8 don't meet; none is grouped wrongly."""
    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    texts |= {100_000 + i: t for i, t in enumerate(chains(rng, 30))}
    docs = spark.createDataFrame([(k, t, "en", "x") for k, t in texts.items()], DOCS).withColumn("node", F.lit("clash")).withColumn("x", F.lit(1))
    left = {r.doc_id for r in neardup.deduplicated(docs).collect()}
    want, pairs = plain_groups(texts)
    kept = {k for k in texts if want.find(k) == k}
    prints = {k: neardup.node_print(neardup.shingle_set(texts[k].encode(), 5), *neardup.layout(len(texts))) for k in {x for p in pairs for x in p}}
    met = [p for p in pairs if meet(prints[p[0]], prints[p[1]])]
    assert kept <= left and len(pairs) > 80 and len(met) >= 0.95 * len(pairs)
    assert not [p for p in met if p[0] in left and p[1] in left]


def test_hot_groups_lose_no_pair_that_meets(spark):
    """Hundreds of near copies of one text, some alike only to a few of the others, among unlike texts that share most of their words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = {}
    for i in range(700):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 9])):
            w[rng.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(k, t, "en", "x") for k, t in texts.items()], DOCS)
    want, pairs = plain_groups(texts)
    prints = {k: neardup.node_print(neardup.shingle_set(t.encode(), 5), *neardup.layout(len(texts))) for k, t in texts.items()}
    group = grouped_as(spark, docs)
    of = {prints[k][:2]: group[k] for k in group}
    met = [p for p in pairs if meet(prints[p[0]], prints[p[1]])]
    assert len(met) > 20_000 and all(of[prints[a][:2]] == of[prints[b][:2]] for a, b in met)
    ends = {}
    for k in texts:
        ends.setdefault(of[prints[k][:2]], set()).add(want.find(k))
    assert all(len(x) == 1 for x in ends.values()) and len(ends) > 5


def test_parity_never_exceeds_the_difference():
    """Sets of all sizes, the empty one too, whose parities have unlike lengths: a lower bound, and sharp enough below the threshold."""
    rng = np.random.default_rng(11)
    for n in (0, 1, 5, 150, 300, 1500, 6000):
        for shared in {0, n // 2, int(0.75 * n), n}:
            more = int(rng.integers(0, 2 * n + 2))
            whole = rng.integers(0, 2**64, 2 * n - shared + more, dtype=np.uint64)
            a, b = whole[:n], whole[n - shared :]
            both = np.array([neardup.parity(a), neardup.parity(b)], object)
            least = int(neardup._differing(both, np.array([0]), np.array([1]))[0])
            assert least <= len(set(a.tolist()) ^ set(b.tolist())) and (len(a) - len(b) - least) % 2 == 0
    for n in (150, 700, 3000):  # 0.7 alike: ruled out
        both = int(n * 0.7 * 2 / 1.7)
        whole = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
        parities = np.array([neardup.parity(whole[:n]), neardup.parity(whole[n - both :])], object)
        assert neardup._differing(parities, np.array([0]), np.array([1]))[0] > 2 * n / 9


def test_every_candidate_is_listed_unless_parity_proves_it_unlike(spark):
    """Sets from quite unlike to nearly equal, of two sizes of parity, in one bucket: all at 0.8 or more are listed, few of the others."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**64, 256, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[int(k) :], rng.integers(0, 2**64, int(j), dtype=np.uint64)])) for k, j in rng.integers(0, 60, (90, 2))]
    rows = [(i, 0, 0, [5], i, len(x), bytearray(neardup.parity(x))) for i, x in enumerate(sets)]
    assert {len(r[-1]) for r in rows} == {64, 128}
    table = spark.createDataFrame(rows, "node long, c0 long, c1 long, segs array<long>, g long, n long, parity binary")
    found = [tuple(r) for r in neardup.every_candidate(table, 8, large=40).collect()]
    of = [set(x.tolist()) for x in sets]
    alike = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a in range(len(of)) for b in range(a)}
    want = {p for p, s in alike.items() if s >= 0.8}
    assert len(found) == len(set(found)) and want <= set(found) and len(want) > 300
    assert all(alike[p] > 0.7 for p in found)


def test_only_nodes_with_untried_candidates_are_dealt_again(spark):
    """A large bucket of like prints: no node of unlike sets has more candidates, and of like sets no pair is lost."""
    rng = np.random.default_rng(13)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    base = fresh(150)
    sets = [np.unique(fresh(150)) for _ in range(120)] + [np.unique(np.concatenate([base[int(k) :], fresh(int(k))])) for k in rng.integers(0, 40, 40)]
    of = [set(x.tolist()) for x in sets]
    want = {(a, b) for a in range(len(of)) for b in range(a) if len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.8}
    for keys in (1, 4):  # one large bucket, and small ones
        rows = [(i, 0, 0, [3 << 2 * (i % keys)], i, len(x), bytearray(neardup.parity(x))) for i, x in enumerate(sets)]
        table = spark.createDataFrame(rows, "node long, c0 long, c1 long, segs array<long>, g long, n long, parity binary")
        here = {p for p in want if p[0] % keys == p[1] % keys}
        for large in (4096, 50):
            found = {tuple(r) for r in neardup.candidates(table, 8, across="g", large=large).collect()}
            more = {u for u, v in found if v == neardup.MORE}
            tried = {p for p in found if p[1] != neardup.MORE}
            if keys > 1 or large > 160:
                assert not any(u < 120 for u in more) and len(tried) < 200
            left = neardup.every_candidate(table.where(F.col("node").isin(*more)), 8).collect() if more else []
            assert here <= tried | {tuple(r) for r in left} and len(here) > 20


def test_a_group_of_near_copies_lists_few_pairs(spark, monkeypatch):
    """Rows that the steps list grow with nodes, not with the buckets that near copies share; two tight groups apart from each other stay apart."""
    rng, made, dealt = random.Random(21), [], neardup._by_bucket
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for first in (0, 500):
        base = [word() for _ in range(150)]
        for i in range(first, first + 400):
            w = list(base)
            w[rng.randrange(len(w))] = word()
            texts[i] = " ".join(w)

    def counted(*given):
        made.append(neardup.stored(dealt(*given), "made"))
        return made[-1]

    monkeypatch.setattr(neardup, "_by_bucket", counted)
    group = grouped_as(spark, spark.createDataFrame([(k, t, "en", "x") for k, t in texts.items()], DOCS))
    assert len(group) == 800 and len({group[k] for k in group if k < 500}) == len({group[k] for k in group if k >= 500}) == 1 and len(set(group.values())) == 2
    assert sum(x.count() for x in made) < 12 * len(group)


def test_nearest_pair_of_each_two_groups():
    """One pair for each two groups of each bucket, the nearest; none of no pairs."""
    rng = np.random.default_rng(6)
    keys, group, check = np.sort(rng.integers(0, 3, 60)), rng.integers(0, 4, 60), rng.integers(0, 1 << 20, (2, 60)).astype(np.uint64)
    u, v = neardup._across(keys, check, group, 128)
    far = lambda a, b: neardup._apart(check, np.array([a]), np.array([b]))[0]
    want = {}
    for a, b in zip(u.tolist(), v.tolist()):
        by = (int(keys[a]), *sorted((int(group[a]), int(group[b]))))
        want[by] = min(want.get(by, 999), far(a, b))
    x, y = neardup._of_groups(keys, check, group, np.concatenate([u, v]), np.concatenate([v, u]))
    assert {(int(keys[a]), *sorted((int(group[a]), int(group[b])))): far(a, b) for a, b in zip(x, y)} == want and len(x) == len(want)
    none = np.zeros(0, np.int64)
    assert [len(z) for z in neardup._of_groups(keys, check, group, none, none)] == [0, 0]


def test_a_bucket_of_one_group_and_few_others_is_told_exactly(spark):
    """Over ``large`` rows: rows far from all others have no more candidates, those near some are listed or have."""
    rng = np.random.default_rng(9)
    check = [[int(x) for x in rng.integers(-(2**63), 2**63 - 1, 2)] for _ in range(123)]
    check[120], check[121] = [check[0][0] ^ 3, check[0][1]], [check[1][0] ^ 1, check[1][1]]
    rows = [(i, *c, [5], 0 if i < 120 else i) for i, c in enumerate(check)]
    table = spark.createDataFrame(rows, "node long, c0 long, c1 long, segs array<long>, g long")
    found = {tuple(r) for r in neardup.candidates(table, 8, across="g", large=60).collect()}
    assert {p for p in found if p[1] != neardup.MORE} == {(120, 0), (121, 1)}
    assert not {p for p in found if p[1] == neardup.MORE}


def table_of(spark, rng, n, extra):
    """Nodes in two buckets, their check words, and the pairs of them within reach."""
    check = [[int(x) for x in rng.integers(-(2**63), 2**63 - 1, 2)] for _ in range(n)]
    rows = [(i, *c, [5, 1 << 8 | 9]) for i, c in enumerate(check)]
    rows += [(1000 + i, check[i][0] ^ 1 << 3, check[i][1], [5, 1 << 8 | 9]) for i in range(0, n, extra)]
    table = spark.createDataFrame(rows, "node long, c0 long, c1 long, segs array<long>").withColumn("g", F.col("node"))
    far = lambda a, b: sum(((a[k] ^ b[k]) & 2**64 - 1).bit_count() for k in (1, 2))
    return table, {(max(a[0], b[0]), min(a[0], b[0])): far(a, b) for i, a in enumerate(rows) for b in rows[:i]}


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_unlike_prints_of_one_bucket(spark, batch):
    """Two hundred unlike nodes in each bucket: what is alike among them is found, whatever the batches and parts."""
    table, far = table_of(spark, np.random.default_rng(5), 200, 10)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        some = {tuple(r) for r in neardup.candidates(table, 8).collect()}
        none = neardup.candidates(table.withColumn("g", F.col("g") % 1000), 8, across="g").where("u = v + 1000").count()
        wide = 55
        for large in (4096, 50):
            grouped = table.withColumns({"g": F.when(F.col("node") < 90, 0).otherwise(F.col("node")), "n": F.when(F.col("node") % 7 == 0, 10).otherwise(8).cast("long")})
            grouped = grouped.withColumn("n", F.when(F.col("node") == 150, 7).otherwise(F.col("n")).cast("long"))
            every = [tuple(r) for r in neardup.every_candidate(grouped, 8, wide, large).collect()]
            sized = lambda p: 150 not in p or not any(x % 7 == 0 for x in p)  # noqa: E731  7 of 10 can't be similar
            assert len(every) == len(set(every)) and set(every) == {p for p, d in far.items() if d <= wide and not p[0] < 90 and sized(p)}
    finally:
        spark.conf.set(key, size)
    pairs = {p for p in some if p[1] != neardup.MORE}
    assert {(1000 + i, i) for i in range(0, 200, 10)} <= pairs <= {p for p, d in far.items() if d <= neardup.CHECK} and none == 0
    assert {p[0] for p in some if p[1] == neardup.MORE} == {r.node for r in table.collect()}  # of a large bucket all may have more


@pytest.mark.parametrize("radius", [12, 30])
def test_nearest_and_all_of_small_buckets(radius):
    rng = np.random.default_rng(radius)
    for size in (60, 200):
        for _ in range(30):
            n = int(rng.integers(1, size))
            keys, group = np.sort(rng.integers(0, 3, n)), rng.integers(0, 9, n)
            check = rng.integers(0, 1 << 20, (2, n)).astype(np.uint64)
            far = lambda i, j: sum(int(check[k, i] ^ check[k, j]).bit_count() for k in (0, 1))
            near = {(i, j) for j in range(n) for i in range(j) if keys[i] == keys[j] and far(i, j) <= radius}
            u, v = neardup._across(keys, check, group, radius)
            got = [tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())]
            assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in near if group[i] != group[j]}
            if size > 60:
                continue
            for own in (None, group):
                u, v, more = neardup._nearest(keys, check, own, radius)
                assert len(set(zip(u.tolist(), v.tolist()))) == len(u)
                for i in range(n):
                    want = sorted(far(i, j) for j in range(n) if (min(i, j), max(i, j)) in near and (own is None or own[i] != own[j]))
                    assert sorted(far(i, j) for j in v[u == i].tolist()) == want[: neardup.PARTNERS]
                    if (keys == keys[i]).sum() <= neardup.NEXT + 1:
                        assert (i in more) == (len(want) > neardup.PARTNERS)


def test_a_pair_counts_in_one_bucket():
    """Of the buckets that two prints share exactly one is the pair's."""
    rng, bits = np.random.default_rng(3), 9
    top = np.arange(6) << bits
    for _ in range(400):
        x = rng.integers(0, 1 << bits, 6)
        y = x.copy()
        for k in range(6):
            for b in rng.choice(bits, rng.integers(0, 4), replace=False):
                y[k] ^= 1 << b
        under = [{int(v) for v in z} | {int(v) | 1 << b for v in z for b in range(bits)} for z in (x | top, y | top)]
        if both := under[0] & under[1]:
            assert int(neardup._first_bucket((x | top)[None], (y | top)[None], bits)[0]) in both


def test_nearest_of_a_large_bucket():
    """Linear work: of 5000 rows of one bucket most pairs a few bits apart are found by the orders, and all rows are to be asked again."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (2, 2500), dtype=np.uint64)
    twin = base.copy()
    twin[0] ^= np.uint64(1) << rng.integers(0, 64, 2500, dtype=np.uint64)
    u, v, more = neardup._nearest(np.zeros(5000, np.int64), np.concatenate([base, twin], axis=1), None, 33)
    found = {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())}
    assert len(u) < 2 * 5000 + 1 and len({(i, i + 2500) for i in range(2500)} & found) > 2300 and len(more) == 5000


def test_similar_sets_of_one_bucket(spark):
    """Sets that all share words: those that are alike are linked, the others stay."""
    sets = {1: range(0, 100), 2: range(60, 160), 3: range(65, 165), 4: range(500, 600)}
    texts = [(k, " ".join(f"w{i}" for i in v), "en", "x") for k, v in sets.items()]
    left = {r.doc_id for r in neardup.deduplicated(spark.createDataFrame(texts, DOCS)).collect()}
    assert left == {1, 2, 4}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (5, "word " * 40_000), (None, "a b"), (None, None), (6, "a b c"), (6, "a b c")]
    docs = spark.createDataFrame([(a, b, None, None) for a, b in rows], DOCS).withColumn("salt", F.lit(1)).withColumn("component", F.lit("clash"))
    got = neardup.deduplicated(docs).collect()
    assert sorted((r.doc_id, (r.text or "")[:6]) for r in got) == [(1, ""), (4, "a b"), (5, "word w"), (6, "a b c")]
    assert neardup.deduplicated(docs).columns == docs.columns
    assert neardup.deduplicated(docs.limit(0)).count() == 0
