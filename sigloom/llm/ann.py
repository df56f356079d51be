"""Approximate nearest neighbours by Euclidean distance: balanced posting lists.

Every vector lies in the list of its nearest centroid, and in those of others that are nearly as near (``BOUNDARY``,
``REPLICAS``).  The centroids are the means of halves of halves of a bounded sample, so that lists are of about one
size.  A graph of the centroids, held by each task, finds them: a search expands the nearest node not yet expanded.  A
query takes all lists up to ``1 + ratio`` times as far as its nearest; the ratio is the smallest that finds the share
``TARGET`` of the true neighbours of some vectors of the sample among the sample, where neighbours are farther than among all.

A list of more rows than ``SLICE`` is dealt on by hashes, and so are the queries of a list.  What is shuffled is each
vector a few times and each query once for each slice that it searches.  A query that finds fewer than it should, for
want of vectors in its lists, searches all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigloom.llm.common import stored

LISTS = 1024  # at most: their centroids go to every task
LIST_ROWS = 256  # that a list should have, until there are LISTS
SAMPLE = 16_384  # vectors that the lists are fitted on, about
JUDGED = 256  # vectors of the sample that the ratio is fitted on
TARGET = 0.97
BOUNDARY = 0.02  # a list so much farther than the nearest takes the vector too
REPLICAS = 3  # lists of a vector, at most
LINKS = 24  # of a centroid in the graph
BEAM = 16  # nodes that a search expands at least
SLICE = 8192  # rows of a list in one task
QUERIES = 4096  # of a slice in one task


def cleaned(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): null ids and vectors, vectors without a component other than zero and those with a null or
    non-finite one are left out; of rows that repeat an id, the least vector counts."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")), F.lit(False)))
    whole = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0))
    v = F.transform(x, lambda c: c.cast("double"))
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; missing components at the end count as zero."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by inner products; rounding shows where they are tiny."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def balanced(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of parts of the sample, of sizes as equal as halving allows; equal means count once."""
    def split(rows: np.ndarray, want: int) -> Iterator[np.ndarray]:
        if want <= 1 or len(rows) < 2:
            yield rows.mean(axis=0)
            return
        two = rows[rng.choice(len(rows), 2, replace=False)]
        cut = len(rows) * (want // 2) // want
        for _ in range(6):
            # Nearer to the first than to the second, and balanced: the median of the difference cuts.
            order = np.argsort(rows @ (two[1] - two[0]), kind="stable")
            two = np.stack([rows[order[:cut]].mean(axis=0), rows[order[cut:]].mean(axis=0)]) if cut else two
        yield from split(rows[order[: max(1, cut)]], want // 2)
        yield from split(rows[order[max(1, cut) :]], want - want // 2)

    return np.unique(np.stack(list(split(sample, lists))), axis=0)


class Graph:
    """Centroids, each linked with its nearest and with some far ones, so that all are reached."""

    def __init__(self, centroids: np.ndarray):
        n = len(centroids)
        self.centroids = centroids
        near = np.concatenate([np.argsort(distances(centroids[a : a + 512], centroids), axis=1, kind="stable")[:, : LINKS + 1] for a in range(0, n, 512)])
        far = (np.arange(n)[:, None] + 2 ** np.arange(max(1, n.bit_length()))) % n
        self.links = np.concatenate([near, far], axis=1)

    def search(self, q: np.ndarray, ratio: float, beam: int = BEAM) -> np.ndarray:
        """Distances of each query's visited centroids, infinite for those not visited.

        A search ends when the nearest node not expanded is beyond ``1 + ratio`` times the nearest of all, and beyond the
        ``beam`` nearest.
        """
        n = len(self.centroids)
        out = np.full((len(q), n), np.inf)
        some = max(1, (1 << 22) // n)
        for at in range(0, len(q), some):
            out[at : at + some] = self._search(q[at : at + some], ratio, min(beam, n))
        return out

    def _search(self, q: np.ndarray, ratio: float, beam: int) -> np.ndarray:
        found = np.full((len(q), len(self.centroids)), np.inf)
        todo = found.copy()  # distances of nodes visited and not yet expanded
        who = np.arange(len(q))
        own = np.linalg.norm(q - self.centroids[0], axis=1)
        found[:, 0] = todo[:, 0] = own
        while len(who):
            node = todo[who].argmin(axis=1)
            d = todo[who, node]
            rows = found[who]
            limit = np.maximum(rows.min(axis=1) * (1 + ratio), np.partition(rows, beam - 1, axis=1)[:, beam - 1])
            go = np.isfinite(d) & (d <= limit)
            who, node = who[go], node[go]
            todo[who, node] = np.inf
            links = self.links[node]
            new = np.isinf(found[who[:, None], links])
            r, c = np.nonzero(new)
            to = links[r, c]
            d = np.linalg.norm(q[who[r]] - self.centroids[to], axis=1)
            found[who[r], to] = d
            todo[who[r], to] = d
        return found


def homes(graph: Graph, v: np.ndarray, boundary: float = BOUNDARY, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that take each vector: the nearest, and others of its boundary."""
    d = graph.search(v, 0.0)
    best = np.argsort(d, axis=1, kind="stable")[:, :replicas]
    near = np.take_along_axis(d, best, axis=1)
    ok = near <= near[:, :1] * (1 + boundary)
    ok[:, 0] = True
    row, col = np.nonzero(ok)
    return row, best[row, col]


def fitted_ratio(graph: Graph, sample: np.ndarray, k: int, target: float = TARGET) -> float:
    """The ratio at which the share ``target`` of the k nearest in the sample lies in the lists searched."""
    step = max(1, len(sample) // JUDGED)
    of = np.full((len(sample), REPLICAS), -1)
    for at in range(0, len(sample), 1024):
        row, where = homes(graph, sample[at : at + 1024])
        of[at + row, np.arange(len(row)) - np.searchsorted(row, row)] = where
    needed = []
    for at in range(0, len(sample), step):  # one at a time: the driver has no room for all
        d = distances(sample[at : at + 1], sample)[0]
        d[at] = np.inf
        best = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        to = distances(sample[at : at + 1], graph.centroids)[0]
        needed.append(np.where(of[best] >= 0, to[of[best]], np.inf).min(axis=1) / max(to.min(), 1e-300))
    needed = np.sort(np.concatenate(needed))
    return float(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) - 1 + 1e-9 if len(needed) else 0.0


def nearest(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): each query's k nearest, itself left out, ties to the smaller id.

    Inner products choose whose distance is worth an exact look.
    """
    out = []
    for at in range(0, len(q), 256):
        part, own = q[at : at + 256], qids[at : at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            size = (v * v).sum(axis=1)
            square = (part * part).sum(axis=1)[:, None] + size - 2 * (part @ v.T)
            slack = 1e-9 * ((part * part).sum(axis=1) + size.max(initial=0))
        square[~np.isfinite(square)] = -np.inf  # too large for this: look at all of them
        mine = own[:, None] == ids
        square[mine] = np.inf
        kth = np.partition(square, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(part), np.inf)
        for i, mask in enumerate((square <= (kth + 2 * slack)[:, None]) & ~mine):
            some = np.flatnonzero(mask)
            with np.errstate(over="ignore"):
                d = np.sqrt(((v[some] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[some], d))[:k]
            out.append((np.full(len(best), own[i]), ids[some][best], d[best]))
    cat = lambda i, kind: np.concatenate([x[i] for x in out]).astype(kind) if out else np.zeros(0, kind)
    return cat(0, np.int64), cat(1, np.int64), cat(2, float)


class Index:
    """Posting lists of a table of vectors, stored in the shared folder."""

    def __init__(self, vectors: DataFrame, k: int = 10, lists: int | None = None, **columns):
        self.spark = vectors.sparkSession
        v = stored(cleaned(vectors, **columns), "vectors")
        row = v.agg(F.count("*"), F.max(F.size("v"))).first()
        self.n, self.width, self.k = row[0], row[1] or 0, k
        if not self.n:
            return
        lists = lists or max(1, min(LISTS, self.n // LIST_ROWS))
        some = F.pmod(F.xxhash64(F.lit(13), "vec_id"), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.lit(float(self.n))
        rows = (v if self.n <= SAMPLE else v.where(some)).orderBy("vec_id").select("v").toArrow()
        sample = np.concatenate([matrix(c, self.width) for c in rows.column(0).chunks]) if rows.num_rows else np.zeros((1, self.width))
        self.graph = Graph(balanced(sample, lists, np.random.default_rng(13)))
        self.ratio = fitted_ratio(self.graph, sample, k)
        self.vectors = v
        self.postings = stored(self._routed(v, homes), "postings")
        self.sizes = {r[0]: r[1] for r in self.postings.groupBy("list").count().collect()}  # LISTS rows at most

    def _routed(self, v: DataFrame, choose) -> DataFrame:
        """(list, vec_id, v): vectors, packed, with each of the lists chosen for them."""
        graph, width = self.spark.sparkContext.broadcast(self.graph), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = matrix(part.column(1), width)
                    row, where = choose(graph.value, x)
                    packed = pa.array([y.tobytes() for y in x], pa.binary())
                    pick = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), part.column(0).take(pick), packed.take(pick)], names=["list", "vec_id", "v"])

        return v.mapInArrow(run, "list long, vec_id long, v binary")

    def _slices(self, asks: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of queries (list, vec_id, v) in the lists that they ask for, a row for each of a slice's best."""
        asked = {r[0]: r[1] for r in asks.groupBy("list").count().collect()}
        split = [(x, -(-self.sizes[x] // SLICE), -(-n // QUERIES)) for x, n in asked.items() if x in self.sizes]
        parts = F.broadcast(self.spark.createDataFrame(split, "list long, slices long, blocks long"))
        own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        rows = self.postings.join(parts, "list").select("list", own("slices").alias("slice"), every("blocks").alias("block"), "vec_id", "v")
        queries = asks.join(parts, "list").select("list", every("slices").alias("slice"), own("blocks").alias("block"), "vec_id", "v")
        width, k = self.width, self.k

        def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            v, q = (np.frombuffer(b"".join(x["v"]), float).reshape(-1, width) for x in (a, b))
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), nearest(a["vec_id"].to_numpy(), v, b["vec_id"].to_numpy(), q, k), strict=True)))

        key = ["list", "slice", "block"]
        return rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")

    def search(self, is_query: Column) -> DataFrame:
        """(query_id, rank, vec_id, score): for every vector that ``is_query`` (over vec_id) its k nearest found."""
        if not self.n:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        queries, ratio, lists = self.vectors.where(is_query), self.ratio, len(self.graph.centroids)

        def near(graph: Graph, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = graph.search(q, ratio)
            return np.nonzero(d <= d.min(axis=1)[:, None] * (1 + ratio))

        def all_of(_: Graph, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(len(q)), lists), np.tile(np.arange(lists), len(q))

        hits = stored(self._slices(stored(self._routed(queries, near), "asks")), "hits")
        found = hits.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= min(self.k, self.n - 1))
        short = queries.join(found.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        if self.n > 1 and not short.isEmpty():
            hits = hits.union(self._slices(stored(self._routed(short, all_of), "asks")))
        once = hits.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, lists: int | None = None, **columns) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector that ``is_query`` (over vec_id) the k nearest others found.

    The score is the Euclidean distance of the vectors as given, in doubles; ties go to the smaller vec_id.  With no more than k
    others all are returned.  Vectors of unlike lengths are compared as if the shorter went on with zeros.  See
    :func:`cleaned` for rows that take no part.  An empty table gives an empty result.
    """
    return Index(vectors, k, lists, **columns).search(is_query)
