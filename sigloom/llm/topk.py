"""Exact top-k by inner product: a KD-tree in each shard.

Vectors near each other are dealt to one cell: median splits of a bounded sample cut the space, and a
cell of more rows than a shard takes is dealt on by hashes.  A shard's tree splits at medians and
keeps tight bounding boxes; a query visits nodes best first by the largest inner product its
box allows, and stops when that is below the kth score.  A query starts in its own shard; the
kth score found there goes along, and only cells whose box allows more are visited at all.  A tree is built once and
stored in the shared folder; what is shuffled is every vector once and a query for each shard that it visits.
"""

from __future__ import annotations

import heapq
import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigloom.llm.common import stored, work_path
from sigloom.llm.warc import _open as opened

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF_ROWS = 64
CELLS = 4096  # at most: their boxes go to every task
SAMPLED = 16  # vectors a cell, about: where the space is cut rests on them, the result doesn't
TASKS = 20_000  # at most, for pairs of a shard and a block of queries


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): components floor(scale * x).  Null vectors and ids, and vectors with null or
    non-finite components, are left out; of rows that repeat an id, the least vector counts."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")), F.lit(False)))
    whole = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, width: int = 0) -> np.ndarray:
    """Rows of whole numbers; missing components at the end count as zero."""
    rows = [np.asarray(x) for x in column]
    out = np.zeros((len(rows), max([width, *map(len, rows)], default=width)), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


class Tree:
    """Nodes in arrays: box ``lo``, ``hi``, children (or -1) and the row range of a leaf."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF_ROWS):
        self.order, self.nodes = np.arange(len(ids)), []
        self._split(v, 0, len(ids), leaf)
        self.ids, self.v = ids[self.order], v[self.order]
        self.lo = np.array([x[0] for x in self.nodes])
        self.hi = np.array([x[1] for x in self.nodes])

    def _split(self, v: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = v[self.order[a:b]]
        lo, hi, at = own.min(axis=0), own.max(axis=0), len(self.nodes)
        self.nodes.append([lo, hi, -1, -1, a, b])
        wide = int((hi - lo).argmax())
        if b - a > leaf and hi[wide] > lo[wide]:
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], mid)]
            self.nodes[at][2] = self._split(v, a, a + mid, leaf)
            self.nodes[at][3] = self._split(v, a + mid, b, leaf)
        return at

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its best (scores, ids), at most ``k``, none below its floor."""
        width = max(q.shape[1], self.v.shape[1])
        q, v, lo, hi = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, self.v, self.lo, self.hi))
        reach = float(np.abs(q).max(initial=0)) * float(max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))) * width
        kind = np.float64 if reach < 2**53 else np.int64  # exact either way
        q, v, lo, hi = (x.astype(kind) for x in (q, v, lo, hi))
        bounds = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
        return [self._best(qids[i], q[i], v, bounds[i], k, floors[i]) for i in range(len(q))]

    def _best(self, qid, q, v, bound, k, kth):
        heap, scores, ids = [(-bound[0], 0)], np.zeros(0, np.int64), np.zeros(0, np.int64)
        while heap and -heap[0][0] >= kth:  # equal scores can still win by a smaller id
            _, at = heapq.heappop(heap)
            _, _, left, right, a, b = self.nodes[at]
            if left >= 0:
                for x in (left, right):
                    if bound[x] >= kth:
                        heapq.heappush(heap, (-bound[x], x))
                continue
            s = v[a:b] @ q
            ok = (s >= kth) & (self.ids[a:b] != qid)
            if ok.any():
                scores, ids = np.concatenate([scores, s[ok].astype(np.int64)]), np.concatenate([ids, self.ids[a:b][ok]])
                if len(scores) >= k:
                    keep = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[keep], ids[keep]
                    kth = max(kth, scores[-1])
        return scores, ids


def _found(qids, results) -> pd.DataFrame:
    n = [len(s) for s, _ in results]
    cat = lambda i: np.concatenate([x[i] for x in results]) if results else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": np.repeat(qids, n).astype(np.int64), "vec_id": cat(1), "score": cat(0)})


def cuts(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree of median splits (dimension, threshold, left, right); children below zero are cells: -1 is cell 0."""
    nodes: list = []

    def split(rows: np.ndarray, want: int) -> int:
        nonlocal found
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(0)
        if want > 1 and len(rows) > 1 and spread.max(initial=0) > 0:
            d = int(spread.argmax())
            x = np.sort(rows[:, d])
            t = x[len(x) // 2] if x[len(x) // 2] > x[0] else x[x > x[0]][0]
            at = len(nodes)
            nodes.append(None)
            low = rows[:, d] < t
            nodes[at] = (d, float(t), split(rows[low], want // 2), split(rows[~low], want - want // 2))
            return at
        found += 1
        return -found

    found = 0
    root = split(sample, cells)
    return nodes if root >= 0 else []


def cells_of(v: np.ndarray, nodes: list) -> np.ndarray:
    """The cell of each row of ``v``; components that it lacks count as zero."""
    cell = np.zeros(len(v), np.int64)
    todo = [(0, np.arange(len(v)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        d, t, left, right = nodes[at]
        low = v[rows, d] < t if d < v.shape[1] else np.full(len(rows), 0 < t)
        for child, own in ((left, rows[low]), (right, rows[~low])):
            if child < 0:
                cell[own] = -child - 1
            elif len(own):
                todo.append((child, own))
    return cell


def _packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as all of them need; the first byte says how many."""
    kind = np.result_type(np.min_scalar_type(int(v.min(initial=0))), np.min_scalar_type(-1 - int(v.max(initial=0))))
    return bytes([kind.itemsize]) + v.astype(f"<i{kind.itemsize}").tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return _matrix([np.frombuffer(x, f"<i{x[0]}", offset=1) for x in rows])


def _with_cell(v: DataFrame, nodes: list) -> DataFrame:
    def run(batches):
        for batch in batches:
            cell = cells_of(_matrix(batch.column(1).to_pylist()), nodes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "v", "cell"])

    return v.mapInArrow(run, "vec_id long, v array<long>, cell long")


def planted(vectors: DataFrame, is_query: Column, k: int, shard_rows: int, folder: str, **columns) -> tuple[DataFrame, DataFrame]:
    """The vectors (vec_id, v, cell, shard) and, a stored table, a row (shard, cell, path, lo, hi) for each tree and one
    (shard, query_id, vec_id, score) for each hit of a query in its own shard."""
    v = stored(quantised(vectors, **columns), "vectors")
    n = v.count()
    cells = min(CELLS, max(1, -(-n // shard_rows)))
    near = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 40)) < F.lit(float(SAMPLED * cells << 40)) / F.lit(float(max(1, n)))
    nodes = cuts(_matrix([r.v for r in v.where(near).select("v").orderBy("vec_id").collect()]), cells) if cells > 1 else []
    dealt = _with_cell(v, nodes)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"))  # a row a cell
    parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / shard_rows).cast("long").alias("parts")))
    dealt = dealt.join(parts, "cell").select("vec_id", "v", "cell", (F.shiftleft("cell", 40) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("shard"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, asks = pdf["vec_id"].to_numpy(), _matrix(pdf["v"]), pdf["asks"].to_numpy(bool)
        tree = Tree(ids, x)
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(pickle.dumps(tree))
        out = _found(ids[asks], tree.search(ids[asks], x[asks], k, np.full(int(asks.sum()), -np.inf)))
        none = [None] * len(out)
        columns = {"cell": pd.array([pdf["cell"].iloc[0], *none], "Int64"), "path": [f"{folder}/{name}", *none], "lo": [x.min(axis=0).tolist(), *none], "hi": [x.max(axis=0).tolist(), *none]}
        columns |= {c: pd.array([None, *out[c].tolist()], "Int64") for c in ("query_id", "vec_id", "score")}
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], **columns})

    schema = "shard long, cell long, path string, lo array<long>, hi array<long>, query_id long, vec_id long, score long"
    # The rows are small and the work is not: a fixed number of partitions isn't merged.
    tasks = min(TASKS, max(1, -(-n // shard_rows)))
    return dealt, stored(dealt.withColumn("asks", is_query).repartition(tasks, "shard").groupBy("shard").applyInPandas(plant, schema), "trees")


def visits(dealt: DataFrame, home: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(shard, path, query_id, q, kth): a row for each other shard that may hold a better vector for a query."""
    trees = home.where("path IS NOT NULL")
    boxes: dict[int, tuple] = {}
    for r in trees.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x")).groupBy("cell", "i").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"), F.count("*").alias("n")).join(trees.groupBy("cell").agg(F.count("*").alias("all")), "cell").collect():
        # A shard whose vectors lack the component has zero there.
        boxes.setdefault(r.cell, []).append((r.i, min(r.lo, 0) if r.n < r.all else r.lo, max(r.hi, 0) if r.n < r.all else r.hi))
    width = max((len(b) for b in boxes.values()), default=0)
    numbers = sorted(boxes)
    lo, hi = np.zeros((2, len(numbers), width))
    for row, c in enumerate(numbers):
        for i, a, b in boxes[c]:
            lo[row, i], hi[row, i] = a, b
    names = np.array(numbers, np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column(1).to_pylist(), width)[:, :width].astype(float)
                kth = np.array([-np.inf if x is None else float(x) for x in part.column(2).to_pylist()])
                bounds = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                # Rounding may lower a bound of large numbers; a visit too many does no harm.
                who, where = np.nonzero(bounds * (1 + 1e-12 * np.sign(bounds)) + 1e-6 >= kth[:, None])
                packed = pa.array([_packed(np.asarray(x)) for x in part.column(1).to_pylist()], pa.binary())
                pick = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(names[where]), part.column(0).take(pick), packed.take(pick), part.column(2).take(pick), part.column(3).take(pick)], names=["cell", "query_id", "q", "kth", "home"])

    kth = home.where("query_id IS NOT NULL").groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    asks = dealt.where(is_query).join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "kth", "shard")
    routed = asks.mapInArrow(run, "cell long, query_id long, q binary, kth long, home long")
    return routed.join(trees.select("cell", "shard", "path"), "cell").where("shard <> home").select("shard", "path", "query_id", "q", "kth")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, **columns) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector that ``is_query`` (over vec_id) the k best others.

    Ties go to the smaller vec_id; with fewer than k others all are returned; an empty table
    gives an empty result.  See :func:`quantised` for rows that take no part.
    """
    dealt, home = planted(vectors, is_query, k, shard_rows, work_path(vectors.sparkSession, "forest"), **columns)
    hits = home.where("query_id IS NOT NULL").select("query_id", "vec_id", "score")
    shards = home.where("path IS NOT NULL").count()
    if shards > 1:
        away = stored(visits(dealt, home, is_query, k), "visits")
        blocks = max(1, -(-away.count() // (shards * query_rows)))

        def search(batches):
            held, tree = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                shard = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for a, b in zip(edges, edges[1:], strict=False):
                    part = batch.slice(a, b - a)
                    path = part.column(1)[0].as_py()
                    if path != held:
                        store, name = opened(path)
                        with store.open_input_file(name) as f:
                            held, tree = path, pickle.loads(f.read())
                    ids = part.column(2).to_numpy()
                    floors = np.array([-np.inf if x is None else float(x) for x in part.column(4).to_pylist()])
                    yield pa.RecordBatch.from_pandas(_found(ids, tree.search(ids, _unpacked(part.column(3).to_pylist()), k, floors)), preserve_index=False)

        tasks = min(shards * blocks, TASKS)
        spread = away.repartition(tasks, "shard", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).sortWithinPartitions("shard")
        hits = hits.union(spread.mapInArrow(search, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
