"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, with document frequencies over
the whole corpus.  A randomised SVD of those passages, its products summed on the executors,
gives a latent space that holds every passage whole: a model takes at most ``PASSAGES`` passages
(or one item) and its rank is their number.  Every document is folded in, in windows of
words, and a window whose projection on a passage reaches a share of the passage's own norm is
a candidate.  A window that holds all words of a passage has a share of one at least, whatever
else it holds and however the words are weighted, and some window holds every passage of a
verbatim item.  A candidate is contamination if, in some span of words not much longer than the item, the longest
common subsequence covers most of the item; a paraphrase, with less covered, must also hold
the item's answer, its last words, in that span.

The corpus is read twice, however large the benchmark is: once to count words, once to judge.  The
benchmark lies in tables; the driver fits one model after another and stores each in the shared folder, and
a task loads them one by one and keeps ``KEPT_BYTES`` of them.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.llm.common import map_rows, stored, work_path
from sigloom.llm.warc import _open as opened

KEPT_BYTES = 64 << 20  # of models in a task
COUNTED = 200_000  # different words that a task counts before it hands them on
STEP = 16  # words a block
PASSAGE = 48  # words
WINDOW = PASSAGE + STEP  # every run of PASSAGE words lies in a window whole
PASSAGES = 256  # of a model
HELD = 0.2  # share of a passage, its words weighted
LIGHT = 0.2  # so much of any passage may be in words that the latent space leaves out
COPIED = 0.8  # share of an item's words in order: a copy
PARAPHRASED = 0.6  # so much is enough if the answer is there
ANSWER = 0.5
SPAN = 1.6  # times the item's words
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (any character beyond ASCII counts as a letter)."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def lcs(item: list[bytes], span: list[bytes]) -> tuple[int, int]:
    """Length of the longest common subsequence, and by how much the item's last quarter lengthens it."""
    where: dict[bytes, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for x in span:
        m = where.get(x, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    gained = ~row & full
    tail = answer_size(len(item))
    return gained.bit_count(), (gained >> (len(item) - tail)).bit_count()


def answer_size(n: int) -> int:
    return max(1, n // 4)


def passages_of(words: list[bytes]) -> int:
    return -(-len(words) // PASSAGE)


def cut(words: list[bytes]) -> list[list[bytes]]:
    """An item's passages, of nearly equal length."""
    ends = np.linspace(0, len(words), passages_of(words) + 1).astype(int)
    return [words[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, place, words, passages): the different items with a word; a stored table."""
    def run(batches):
        for batch in batches:
            rows = [(i, w) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (w := words_of(t))]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([i for i, _ in rows], pa.int64()), "words": pa.array([w for _, w in rows], pa.list_(pa.binary())), "passages": pa.array([passages_of(w) for _, w in rows], pa.int64())})

    known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    return stored(known.mapInArrow(run, "item_id long, words array<binary>, passages long").withColumn("place", F.xxhash64("item_id", "words")), "items")


def document_counts(docs: DataFrame, items: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """(word, n): in how many documents each word of the items occurs, a stored table; and the number of all documents."""
    def run(batches):
        seen, rows = Counter(), 0

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(words_of(text)))
                rows += 1
                if len(seen) > COUNTED:
                    yield out()
                    seen = Counter()
        seen[None] = rows
        yield out()

    counts = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = items.select(F.explode("words").alias("word")).distinct()
    total = counts.join(words.withColumn("own", F.lit(True)), "word", "left").where("own OR word IS NULL").select("word", "n")
    found = stored(total, "words")
    documents = found.where("word IS NULL").first()
    return found.where("word IS NOT NULL"), documents.n if documents else 0


class Latent:
    """Vocabulary, weights, latent basis and the query passages of some items, given as words."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = items
        vocabulary = sorted({x for _, w in self.items for x in w})
        self.number = {x: k for k, x in enumerate(vocabulary)}
        self.passages = []  # (item's place, feature numbers)
        for k, (_, w) in enumerate(self.items):
            self.passages += [(k, [self.number[x] for x in p]) for p in cut(w)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(x, -1) for x in words), np.int64, len(words))

    def fit(self, table: DataFrame, counts: dict[bytes, int], documents: int, power: int = 2, seed: int = 11) -> None:
        """``table`` holds the same items; their passages become rows of the matrix on the executors."""
        held = np.array([counts.get(x, 0) for x in self.number], float)
        self.idf = np.log((documents + 1) / (held + 1)) + 0.1
        light = self._light(held)
        self.passages = [(k, [x for x in p if not light[x]]) for k, p in self.passages]
        number, idf = self.number, self.idf

        def rows(batches):
            for batch in batches:
                made = []
                for words in batch.column(0).to_pylist():
                    for p in cut(words):
                        at, n = np.unique([i for x in p if not light[i := number[x]]], return_counts=True)
                        made.append((at.tolist(), (n * idf[at]).tolist()))
                yield pa.RecordBatch.from_pydict({"at": pa.array([x[0] for x in made], pa.list_(pa.int64())), "w": pa.array([x[1] for x in made], pa.list_(pa.float64()))})

        matrix = table.select("words").mapInArrow(rows, "at array<long>, w array<double>")
        # The rank is that of all passages: a lower one would shorten every window, more the more passages there are.
        basis = randomised_svd(matrix, len(self.number), min(len(self.passages), len(self.number)), power, seed)
        self.scaled = (basis * self.idf[:, None]).astype(np.float32)
        self.latent = np.append(~light, False)  # words outside the vocabulary come last
        # Squared weights, a word outside the vocabulary last: it counts as the rarest inside.
        self.squares = np.append(self.idf, self.idf.max()).astype(np.float32) ** 2
        q = np.stack([self.scaled[x].sum(axis=0) for _, x in self.passages])
        self.norms = np.linalg.norm(q, axis=1)
        self.queries = q / self.norms[:, None] ** 2  # a vector's product with one is the share of the passage that it holds
        self.owner = np.array([k for k, _ in self.passages])

    def _light(self, held: np.ndarray) -> np.ndarray:
        """The most frequent words, as long as every passage keeps all but LIGHT of its weight.

        They are most of a corpus, and no passage depends on them: one whose words are all frequent keeps them.
        """
        within: list[list[tuple[int, float]]] = [[] for _ in self.number]
        left = np.empty(len(self.passages))
        for k, (_, p) in enumerate(self.passages):
            at, w = self._weighted(p)
            left[k] = LIGHT * (w * w).sum()
            for x, v in zip(at, w * w, strict=True):
                within[x].append((k, v))
        light = np.zeros(len(self.number), bool)
        for x in np.argsort(-held, kind="stable"):
            light[x] = all(left[k] >= v for k, v in within[x])
            if light[x]:
                for k, v in within[x]:
                    left[k] -= v
        return light

    def _weighted(self, x: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(x, return_counts=True)
        return at, n * self.idf[at]

    def windows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors of the windows that start at every STEP words, and the norms of all their words."""
        blocks = -(-len(numbers) // STEP)
        more = WINDOW // STEP - 1
        sums, norms = np.zeros((blocks + more, self.scaled.shape[1]), np.float32), np.zeros(blocks + more, np.float32)
        norms[:blocks] = np.add.reduceat(self.squares[numbers], np.arange(0, len(numbers), STEP))
        known = np.flatnonzero(self.latent[numbers])
        if len(known):
            own = known // STEP
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[first]] = np.add.reduceat(self.scaled[numbers[known]], first, axis=0)
        total = sum(sums[i : i + blocks] for i in range(more + 1))
        norm = sum(norms[i : i + blocks] for i in range(more + 1))
        return total, np.sqrt(np.maximum(norm, 1e-9))

    def judge(self, texts: list[list[bytes]]) -> list[list[tuple[int, float, float, float]]]:
        """For each text, given as words, its contaminations (item, cosine, share covered, share of the answer)."""
        out: list[list] = [[] for _ in texts]
        for slot, words in enumerate(texts):
            if not words:
                continue
            numbers = self.numbers(words)
            latent, norms = self.windows(numbers)
            best: dict[int, list[tuple[int, float]]] = {}
            # A shorter window can't hold so much of any passage.
            able = np.flatnonzero((latent * latent).sum(axis=1) >= (HELD * self.norms.min()) ** 2)
            for at in range(0, len(able), 4096):
                held = latent[able[at : at + 4096]] @ self.queries.T
                for i, j in zip(*np.nonzero(held >= HELD), strict=True):
                    w = able[at + i]
                    best.setdefault(int(self.owner[j]), []).append((int(w), float(held[i, j] * self.norms[j] / norms[w])))
            for k, hits in sorted(best.items()):
                if (found := self._verified(k, words, hits)) is not None:
                    out[slot].append(found)
        return out

    def _verified(self, k: int, words: list[bytes], hits: list[tuple[int, float]]):
        """The best span around the hits that is a copy or a paraphrase of the whole item with its answer, if any is."""
        item, w = self.items[k]
        width, grid = int(len(w) * SPAN) + 2, max(1, len(w) // 4)
        starts = sorted({max(0, s) for i, _ in hits for s in range((i * STEP - len(w)) // grid * grid, i * STEP + WINDOW, grid)})
        own = set(w)
        inside = np.append(0, np.cumsum([x in own for x in words]))
        top = None
        for s in starts:
            e = min(len(words), s + width)
            if s >= e or inside[e] - inside[s] < PARAPHRASED * len(w):
                continue  # no subsequence can be long enough
            n, answer = lcs(w, words[s:e])
            got = (n / len(w), answer / answer_size(len(w)))
            if got[0] >= COPIED or (got[0] >= PARAPHRASED and got[1] >= ANSWER and len(w) >= 8):
                top = got if top is None else max(top, got)
        return None if top is None else (item, max(c for _, c in hits), *top)


def randomised_svd(matrix: DataFrame, n_features: int, rank: int, power: int = 2, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (n_features, rank) of sparse rows (at, w).

    Each step multiplies the current basis by A'A: tasks handle their rows, sums of features are
    shuffled, and the product, as large as the vocabulary, is orthonormalised on the driver.
    """
    size = min(rank + 8, n_features)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_features, size)))[0]
    for step in range(power + 1):
        now = basis

        def products(parts, now=now):
            for pdf in parts:
                sums: dict[int, np.ndarray] = {}
                for at, w in zip(pdf["at"], pdf["w"], strict=True):
                    row = np.asarray(w) @ now[np.asarray(at)]
                    for i, v in zip(at, w, strict=True):
                        sums[i] = sums.get(i, 0) + v * row
                yield pd.DataFrame({"i": list(sums), "v": list(sums.values())})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf.groupby("i")["v"].apply(lambda x: np.sum(np.stack(x.to_numpy()), axis=0))
            return pd.DataFrame({"i": own.index, "v": list(own)})

        made = matrix.mapInPandas(products, "i long, v array<double>")
        total = np.zeros_like(basis)
        for r in made.groupBy(F.pmod("i", F.lit(64))).applyInPandas(added, "i long, v array<double>").collect():
            total[r.i] = r.v
        if step < power:
            basis = np.linalg.qr(total)[0]
    values, rotate = np.linalg.eigh(basis.T @ total)
    return basis @ rotate[:, np.argsort(-values)[:rank]]


def _models(docs: DataFrame, benchmark: DataFrame, text_col: str) -> list[str]:
    """Paths of the fitted models; null ids and texts without a word are left out.

    Items are dealt to models by their place in hash order: a model takes runs of it with at most PASSAGES passages, or
    one longer item.  The driver holds the place and size of each item, and one model at a time.
    """
    items = items_of(benchmark)
    order = items.select("place", "passages").orderBy("place", "item_id").collect()  # two numbers an item
    runs, size = [], PASSAGES + 1
    for r in order:
        if size + r.passages > PASSAGES and (not runs or runs[-1][-1] != r.place):
            runs.append([])
            size = 0
        runs[-1].append(r.place)
        size += r.passages
    if not runs:
        return []
    counts, documents = document_counts(docs, items, text_col)
    folder = work_path(docs.sparkSession, "models")
    store, base = opened(folder)
    store.create_dir(base, recursive=True)
    paths = []
    for k, run in enumerate(runs):
        own = items.where(F.col("place").between(run[0], run[-1]))
        model = Latent(sorted((r.item_id, list(map(bytes, r.words))) for r in own.select("item_id", "words").collect()))
        words = own.select(F.explode("words").alias("word")).distinct()
        model.fit(own, {bytes(r.word): r.n for r in counts.join(words, "word").collect()}, documents)
        paths.append(f"{folder}/{k}.pickle")
        with store.open_output_stream(f"{base}/{k}.pickle") as f:
            f.write(pickle.dumps(model))
    return paths


def _hits(docs: DataFrame, paths: list[str], keep: list[str], text_col: str) -> DataFrame:
    def make():
        kept: dict[str, Latent] = {}
        size = 0

        def model_of(path: str) -> Latent:
            nonlocal size
            if path in kept:
                return kept[path]
            store, name = opened(path)
            with store.open_input_file(name) as f:
                data = f.read()
            model = pickle.loads(data)
            if size + len(data) <= KEPT_BYTES or not kept:
                kept[path] = model
                size += len(data)
            return model

        def run(texts):
            words = [words_of(x) for x in texts]
            found = [[] for _ in texts]
            for path in paths:
                for own, more in zip(found, model_of(path).judge(words), strict=True):
                    own += more
            return {n: [[x[i] for x in y] for y in found] for i, n in enumerate(("__items", "__cosine", "__covered", "__answer"))}

        return run

    kinds = (T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    fields = [T.StructField(n, T.ArrayType(t)) for n, t in zip(("__items", "__cosine", "__covered", "__answer"), kinds, strict=True)]
    return map_rows(docs, make, fields, keep, text_col, 256)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, covered, answer): every document with a benchmark item in it, a row for each item.

    Null and empty texts hold nothing; rows that repeat an id are judged on their own; repeated
    items count once; an empty corpus or benchmark gives an empty result.
    """
    paths = _models(docs, benchmark, text_col)
    found = _hits(docs, paths, [id_col], text_col).select(id_col, F.explode(F.arrays_zip("__items", "__cosine", "__covered", "__answer")).alias("x"))
    return found.select(id_col, F.col("x.__items").alias("item_id"), F.col("x.__cosine").alias("cosine"), F.col("x.__covered").alias("covered"), F.col("x.__answer").alias("answer"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    Rows with null and empty texts stay, as do rows that repeat another unless they hold an item; an empty corpus
    gives an empty result and an empty benchmark leaves all rows.
    """
    paths = _models(docs, benchmark, text_col)
    return _hits(docs, paths, docs.columns, text_col).where(F.size("__items") == 0).select(*docs.columns)
