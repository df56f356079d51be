"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``STEPS`` bytes (the last is padded).  In each, one GRU reads forwards and one
backwards; both states together label every byte position, and a document's probabilities
are the mean over the positions of its whole text.  The network is trained in numpy by
backpropagation through time on a bounded sample (``PER_LANGUAGE`` documents a language,
``WINDOWS`` windows of STEPS characters of each); everything else covers all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sigloom.llm.common import map_rows, remainder

STEPS = 64
HIDDEN = 8
PER_LANGUAGE = 600
WINDOWS = 4
EPOCHS = 6
BATCH = 128
PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


def start_weights(n_langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w["E" + d] = rng.normal(0, 0.3, (3 * HIDDEN, PAD + 1))  # input weights, a column a byte
        w["U" + d] = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN))
        w["c" + d] = np.zeros((3 * HIDDEN, 1))
    w["V"] = rng.normal(0, 0.3, (n_langs, 2 * HIDDEN))
    w["o"] = np.zeros((n_langs, 1))
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_direction(w, d: str, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (STEPS, HIDDEN, batch) for bytes ``x`` (STEPS, batch); padding leaves a state as it is."""
    E, U, c, n = w["E" + d] + w["c" + d], w["U" + d], HIDDEN, x.shape[1]
    h, out = np.zeros((c, n), np.float32), np.empty((len(x), c, n), np.float32)
    padded = bool((x == PAD).any())
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        g = E.take(x[t], axis=1)
        u = U @ h
        zr = _sigmoid(g[: 2 * c] + u[: 2 * c])
        z, r = zr[:c], zr[c:]
        m = np.tanh(g[2 * c :] + r * u[2 * c :])
        new = m + z * (h - m)
        if padded:
            live = x[t] != PAD
            new = np.where(live, new, h)
        if trace is not None:
            trace.append((t, h, z, r, m, u[2 * c :].copy()))
        out[t] = h = new
    return out


def position_probs(w, x: np.ndarray) -> np.ndarray:
    """Label probabilities (STEPS, languages, batch) of every position."""
    states = np.concatenate([run_direction(w, d, x) for d in "fb"], axis=1)
    return softmax(np.matmul(w["V"], states) + w["o"])


def softmax(s: np.ndarray) -> np.ndarray:
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    return s


def gradients(w, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    c, traces = HIDDEN, {"f": [], "b": []}
    states = np.concatenate([run_direction(w, d, x, traces[d]) for d in "fb"], axis=1)
    p = softmax(np.matmul(w["V"], states) + w["o"])
    live = (x != PAD)[:, None, :].astype(np.float32)
    total = max(1.0, float(live.sum()))
    cols = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, y, cols] + 1e-9) * live[:, 0]).sum() / total)
    ds = p.copy()
    ds[:, y, cols] -= 1
    ds *= live / total
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["V"] = np.einsum("tlb,thb->lh", ds, states)
    g["o"] = ds.sum(axis=(0, 2))[:, None]
    dstates = np.matmul(w["V"].T, ds)
    for k, d in enumerate("fb"):
        U, dh = w["U" + d], np.zeros((c, x.shape[1]), np.float32)
        for t, h, z, r, m, um in reversed(traces[d]):
            on = live[t]
            dh = dh + dstates[t, k * c : (k + 1) * c] * on
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (h - m) * z * (1 - z)
            dr = dm * um * r * (1 - r)
            da = np.concatenate([dz, dr, dm]) * on  # by the input sums
            du = np.concatenate([dz, dr, dm * r]) * on  # by the recurrent sums
            np.add.at(g["E" + d].T, x[t], da.T)
            g["c" + d][:, 0] += da.sum(axis=1)
            g["U" + d] += du @ h.T
            dh = np.where(on > 0, dh * z + U.T @ du, dh)
    return loss, g


def train(x: np.ndarray, y: np.ndarray, n_langs: int, epochs: int = EPOCHS, batch: int = BATCH, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over minibatches of segments ``x`` (rows, STEPS) with language numbers ``y``; gradients are cut to norm 1."""
    w, rng = start_weights(n_langs, seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    steps = max(60, epochs * len(x) // batch)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(batch, len(x)))
        _, g = gradients(w, x[pick].T, y[pick])
        norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
        clip, rate = min(1.0, 1.0 / (norm + 1e-9)), 0.02 * (1 - 0.9 * step / steps)
        for k, v in g.items():
            v = v * clip
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return w


def segments(raw: bytes) -> np.ndarray:
    """The bytes as rows of STEPS, the last padded."""
    n = -(-len(raw) // STEPS)
    out = np.full(n * STEPS, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, STEPS)


def below_cut(id: Column, n: Column) -> Column:
    """True for about twice PER_LANGUAGE of ``n`` ids; the bound is a double, as a product of longs overflows."""
    return F.pmod(F.xxhash64(F.lit(3), id), F.lit(1 << 40)) < F.lit(float(2 * PER_LANGUAGE << 40)) / n


def fit(docs: DataFrame, held_out: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, weights) learnt from text and non-null language of rows outside the held-out split."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col, held_out) != 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # A cut through the hashes leaves about twice as many as are wanted to be ranked, however many there are.
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    near = ids.join(F.broadcast(sizes), "lang").where(below_cut(F.col("id"), F.col("n"))).select("id", "lang")  # a row a language
    picked = near.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_LANGUAGE)
    texts = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    size = F.greatest(F.length("text") - STEPS, F.lit(0)) + 1
    spots = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS)), lambda i: F.encode(F.substring("text", (F.pmod(F.xxhash64("id", i), size) + 1).cast("int"), F.lit(STEPS)), "UTF-8"))
    # The picked ids are bounded by PER_LANGUAGE a language: the broadcast is too.
    # Of rows that repeat an id and language one is taken, so what is collected is bounded by ids.
    windows = texts.join(F.broadcast(picked.drop("k")), ["id", "lang"]).groupBy("lang", "id").agg(F.min(spots).alias("spots"))
    rows = windows.select("lang", F.explode("spots").alias("raw")).where(F.length("raw") > 0).collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return [], None
    rows.sort(key=lambda r: (r.lang, bytes(r.raw)))
    # A window of STEPS characters is one to four segments of bytes; all of them train.
    cut = [segments(bytes(r.raw)) for r in rows]
    x = np.concatenate(cut)
    y = np.repeat([langs.index(r.lang) for r in rows], [len(c) for c in cut])
    return langs, train(x, y, len(langs))


def label(texts: list[str | None], langs: list[str], w, at_once: int = 2048) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text."""
    parts, sizes = [], []
    for text in texts:
        lettered = text is not None and any(c.isalpha() for c in text)
        seg = segments(text.encode("utf-8", "replace")) if lettered and langs else np.zeros((0, STEPS), np.int16)
        parts.append(seg)
        sizes.append(len(seg))
    x = np.concatenate(parts) if parts else np.zeros((0, STEPS), np.int16)
    sums, counts = np.zeros((len(x), max(1, len(langs)))), np.zeros(len(x))
    full = x[:, -1] != PAD if len(x) else np.zeros(0, bool)
    for rows in (np.flatnonzero(full), np.flatnonzero(~full)):
        for at in range(0, len(rows), at_once):
            own = rows[at : at + at_once]
            b = np.ascontiguousarray(x[own].T).astype(np.intp)
            p = position_probs(w, b)
            if x[own[-1], -1] == PAD:
                p *= (b != PAD)[:, None, :]
            sums[own] = p.sum(axis=0).T
            counts[own] = (b != PAD).sum(axis=0)
    names, scores, at = [], [], 0
    for n in sizes:
        if n == 0:
            names.append("und")
            scores.append(0.0)
            continue
        mean = sums[at : at + n].sum(axis=0) / counts[at : at + n].sum()
        at += n
        best = int(mean.argmax())
        names.append(langs[best])
        scores.append(float(min(1.0, max(0.0, mean[best]))))
    return names, scores


def identify(docs: DataFrame, held_out: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", also: list[str] | None = None) -> DataFrame:
    """Per row: id, held_out, lang_pred, score, and the columns named in ``also``.

    A null text, and one without a letter, is ``und`` with score 0, as is every text where no
    labelled row exists.  Ties go to the language first in order.  Rows that repeat an id are
    predicted each on their own; an empty table gives an empty result.
    """
    langs, w = fit(docs, held_out, id_col, text_col, lang_col)

    def make():
        return lambda texts: dict(zip(("lang_pred", "score"), label(texts, langs, w), strict=True))

    src = docs.withColumn("held_out", F.coalesce(remainder(id_col, held_out) == 0, F.lit(False)))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_rows(src, make, fields, [*dict.fromkeys([id_col, "held_out", *(also or [])])], text_col, 256)
