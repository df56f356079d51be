"""Quality scores from a regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics.  Class means and covariances are summed
over all labelled rows outside the held-out split; each covariance is shrunk towards the
pooled one and towards a multiple of the identity.  A score is the logistic of the
difference of the two Mahalanobis log densities, from Cholesky factors that are computed
once and sent along.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.llm.common import remainder, stored

POOLED = 0.2  # weight of the pooled covariance in each class covariance
RIDGE = 0.05  # weight of the identity, scaled to the mean variance
THRESHOLD = 0.7
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\=_+", np.uint8)
N_FEATURES = 16


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of one whole text; zeros if it is empty."""
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    upper, lower, digits, high = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    space = c[32] + c[9:14].sum()
    words, lines = raw.split(), raw.split(b"\n")
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    p = c[c > 0] / n
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p((n - space) / max(1, len(words))),
        np.sqrt(upper / (upper + lower + 1)),
        np.sqrt(digits / n),
        np.sqrt(c[_SYMBOLS].sum() / n),
        np.sqrt(c[33] / n),
        np.sqrt(c[124] / n),
        np.sqrt((n - upper - lower - digits - high - space) / n),
        np.log1p(len(seen)) / np.log1p(max(1, len(words))),
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        float(-(p * np.log(p)).sum()),
        sum(k for w, k in seen.items() if len(w) <= 3) / max(1, len(words)),
        np.sqrt(high / n),
        1 - pairs / max(1, len(words) - 1),
    ]


def features(docs: DataFrame, held_out: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, x): the split and the statistics of every row; a null text counts as empty."""
    src = docs.select(F.col(id_col), F.coalesce(remainder(id_col, held_out) == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("__text"))
    schema = T.StructType([src.schema[id_col], src.schema["held_out"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = [statistics(b or b"") for b in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(x, pa.list_(pa.float64()))], names=[id_col, "held_out", "x"])

    return src.mapInArrow(run, schema)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` for each label, added up on the executors."""
    def run(batches):
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(y), -1)
            for k in np.unique(y):
                own = x[y == k]
                sums = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), k), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["y", "k", "v"])

    parts = labelled.select("y", "x").mapInArrow(run, "y int, k int, v double")
    found: dict[int, list[float]] = {}
    for r in parts.groupBy("y", "k").agg(F.sum("v").alias("v")).orderBy("y", "k").collect():  # 1 + d + d * d numbers a label
        found.setdefault(r.y, []).append(r.v)
    d = N_FEATURES
    return {y: (v[0], np.array(v[1 : d + 1]), np.array(v[d + 1 :]).reshape(d, d)) for y, v in found.items()}


class Discriminant:
    """Two shrunk Gaussians over standardised statistics."""

    def __init__(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = sum(v[0] for v in found.values())
        self.prior = {y: (found[y][0] if y in found else 0) for y in (0, 1)}
        self.ready = min(self.prior.values()) >= 2
        if not self.ready:
            return
        self.shift = sum(v[1] for v in found.values()) / n
        var = np.diag(sum(v[2] for v in found.values())) / n - self.shift**2
        self.scale = np.sqrt(np.maximum(var, 1e-8))
        mean = {y: (found[y][1] / found[y][0] - self.shift) / self.scale for y in (0, 1)}
        cov = {}
        for y in (0, 1):
            k, m = found[y][0], found[y][1] / found[y][0]
            cov[y] = (found[y][2] / k - np.outer(m, m)) / np.outer(self.scale, self.scale)
        pooled = sum(self.prior[y] * cov[y] for y in (0, 1)) / n
        self.mean, self.inverse, self.const = mean, {}, {}
        for y in (0, 1):
            s = (1 - POOLED) * cov[y] + POOLED * pooled
            s = (1 - RIDGE) * s + RIDGE * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
            root = np.linalg.cholesky(s)
            self.inverse[y] = np.linalg.solve(root, np.eye(len(s)))
            self.const[y] = np.log(self.prior[y] / n) - np.log(np.diag(root)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), (self.prior[1] + 1) / (self.prior[0] + self.prior[1] + 2))
        z = (x - self.shift) / self.scale
        log = {y: self.const[y] - 0.5 * (((z - self.mean[y]) @ self.inverse[y].T) ** 2).sum(axis=1) for y in (0, 1)}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: id, held_out, score in [0, 1], predicted.

    Labels other than 0 and 1, null labels and null ids teach nothing; a repeated labelled row
    counts each time.  With fewer than two rows of a class every score is the smoothed share of
    label 1 (0.5 without labels).  Empty and null texts are scored like others, from zeros.
    """
    x = stored(features(docs, held_out, id_col, text_col), "features")
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("y"))
    model = Discriminant(moments(x.where(~F.col("held_out")).join(known, id_col)))
    schema = T.StructType([x.schema[id_col], x.schema["held_out"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            v = np.array(batch.column(2).to_pylist(), float).reshape(batch.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(model.score(v))], names=[id_col, "held_out", "score"])

    return x.select(id_col, "held_out", "x").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
