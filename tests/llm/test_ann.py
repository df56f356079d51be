import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import ann
from sigloom.llm.queries import op13_ann

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_force(ids, v, asks, k):
    """{query: [(distance, id)]} of all others."""
    out = {}
    for i in np.flatnonzero(asks):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(float(d[j]), int(ids[j])) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    assert set(got) == set(want)
    for q, hits in got.items():
        assert len(hits) == len(want[q]) and hits == sorted(hits) and len({i for _, i in hits}) == len(hits)
    return np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want])


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in r], 1) for i, r in zip(ids, v, strict=True)], VECTORS).repartition(4)


def test_query_recall(spark):
    d = "/root/testdata/sf0.1"
    got = op13_ann(spark, d)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute_force(ids, v, ids % 100 == 0, 10)
    hits = found(got.collect())
    assert recall(hits, want) >= 0.93
    at = {int(x): i for i, x in enumerate(ids)}
    for q, near in hits.items():  # scores are exact
        assert all(abs(s - np.sqrt(((v[at[q]] - v[at[i]]) ** 2).sum())) <= 1e-15 * s for s, i in near)


@pytest.mark.parametrize("hot", [0, 900])
def test_clusters_copies_and_slices(spark, hot, monkeypatch):
    """Lists cut in slices, queries in blocks, a very common vector."""
    monkeypatch.setattr(ann, "SLICE", 100)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(hot)
    v = (rng.normal(0, 1, (40, 12))[rng.integers(0, 40, 2400)] + rng.normal(0, 0.2, (2400, 12))).astype(np.float32).astype(float)
    v[100 : 100 + hot] = v[100]
    ids = rng.permutation(len(v)) * 3
    index = ann.Index(frame(spark, ids, v), 10, lists=30)
    assert len(index.sizes) > 15 and sum(index.sizes.values()) > len(v)
    got = found(index.search(F.col("vec_id") % 10 == 0).collect())
    want = brute_force(ids, v, ids % 10 == 0, 10)
    assert recall(got, want) >= 0.95
    if hot:  # of equal vectors the smallest ids
        copies = np.sort(ids[100 : 100 + hot])
        q = int(copies[copies % 10 == 0][-1])
        assert got[q] == [(0.0, int(i)) for i in copies[:10]]
    d = index.graph.search(v[:50], index.ratio)
    share = (d <= d.min(axis=1)[:, None] * (1 + index.ratio)).mean()
    assert share < 0.5  # the ratio prunes where there are clusters


def test_few_candidates_are_all_returned(spark):
    """Lists of fewer than k vectors: the search goes on in all lists."""
    v = np.array([[i // 4 * 100.0 + i % 4, 1.0] for i in range(24)])
    got = found(ann.Index(frame(spark, np.arange(24), v), 20, lists=6).search(F.col("vec_id") % 5 == 0).collect())
    assert got == brute_force(np.arange(24), v, np.arange(24) % 5 == 0, 20)
    got = found(ann.neighbours(frame(spark, np.arange(4), v[:4]), F.col("vec_id") < 9, 10).collect())
    assert got == brute_force(np.arange(4), v[:4], np.arange(4) < 9, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (None, [1.0, 1.0], 1), (6, [], 1), (7, [2.0], 1), (8, [1.0, 1.0], None), (8, [0.5, 9.0], 1), (9, [3e38, -3e38], 1)]
    got = found(ann.neighbours(spark.createDataFrame(rows, VECTORS).withColumns({"list": F.lit(1), "v": F.lit(2), "score": F.lit(3)}), F.col("vec_id") % 2 == 0).collect())
    assert {q: [i for _, i in hits] for q, hits in got.items()} == {0: [7, 8, 9], 8: [0, 7, 9]}
    assert got[0][0][0] == 1.0 and got[8][0][0] == np.sqrt(0.5**2 + 81)
    assert ann.neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).collect() == []
    assert ann.neighbours(spark.createDataFrame(rows[:2], VECTORS), F.col("vec_id") == 0).collect() == []


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(8)
    c, q = rng.normal(0, 1, (700, 8)), rng.normal(0, 1, (60, 8))
    d = ann.Graph(c).search(q, 0.3)
    full = ann.distances(q, c)
    near = full <= full.min(axis=1)[:, None] * 1.3
    assert (np.isfinite(d) & near).sum() >= 0.99 * near.sum()
    assert np.isfinite(d).mean() < 0.6 and np.allclose(d[np.isfinite(d)], full[np.isfinite(d)])


def test_balanced_parts():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1000, 5))
    x[:600] = x[0]
    c = ann.balanced(x, 16, rng)
    assert len(c) == len(np.unique(c, axis=0)) <= 16
    x = rng.normal(0, 1, (1000, 5))
    c = ann.balanced(x, 13, rng)
    sizes = np.bincount(ann.distances(x, c).argmin(axis=1), minlength=13)
    assert len(c) == 13 and sizes.min() > 20 and sizes.max() < 200
