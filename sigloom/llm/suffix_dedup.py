"""Removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts earlier: in a document
of smaller id, or further left in the same one.  Suffixes are dealt so that equal strings
meet without sending the corpus around once for each:

1. Each string of SPAN bytes has an anchor, the leftmost least of its k-gram hashes.  Strings
   that follow one another and share an anchor are one segment; equal strings have equal
   anchors at equal places.  One row a segment, some bytes long, is shuffled by its anchor.
2. Copies are folded before anything is sorted: segments equal in 128-bit BLAKE2 digests are one
   string, and all of its places but the first are repeats.  A family with several strings is
   sorted: their text is fetched, a suffix array of the family is built by linear grouping
   (:mod:`sigloom.llm.gsaca`), and of neighbours that agree in SPAN bytes all but the earliest
   are repeats.  A long family is cut into shorter ones by anchors of other hashes first.
3. No task holds a hot anchor: a family of more than ``LARGE`` strings is dealt on by its windows of SPAN
   bytes.  Those go to the same suffix arrays, seven bytes a symbol, and only those that copy one of
   their batch are folded before.
4. The repeats of each document are united and cut out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.llm.common import stored
from sigloom.llm.gsaca import suffix_arrays

SPAN = 100
GRAM = 32
WIDTH = SPAN - GRAM + 1  # k-grams in a string
MIDDLE = 48  # strings that are sorted as one family
ROUNDS = 4  # of splitting a family
LARGE = 512  # strings of an anchor; more are dealt on by their windows
SMALL_TABLE = 1_000_000  # rows of two numbers that may be broadcast
PACKED = 7  # bytes a symbol where only whole windows are sorted
PIECE = 1 << 20  # window starts hashed at a time
SORTED_AT_ONCE = 2 << 20  # symbols
NO_ID = 2**63 - 1  # place of null ids: after all others, and after this one

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def segment_rows(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor hash, both halves of the digest) of every segment.

    Another ``seed`` makes other grams the least, and leaves the digests out.
    """
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    todo: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal todo, held
        if todo:
            for a, b in zip(out, _segments(todo, seed), strict=True):
                a.append(b)
        todo, held = [], 0

    for k, text in enumerate(texts):
        for at in range(0, len(text) - SPAN + 1, PIECE):
            todo.append((k, at, text[at : at + PIECE + SPAN - 1]))
            held += len(todo[-1][2])
            if held >= PIECE:
                flush()
    flush()
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64 if i > 2 else np.int64) for i, x in enumerate(out))


def _segments(pieces: list[tuple[int, int, bytes]], seed: int) -> tuple[np.ndarray, ...]:
    raw = b"".join(x[2] for x in pieces)
    buf = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(x[2]) for x in pieces])
    up, down = _power(len(buf))
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up, out=h[1:])
    gram = _mixed((h[GRAM:] - h[:-GRAM]) * down[: len(buf) - GRAM + 1] ^ _U(seed * _BASE & 2**64 - 1))
    # The place in the low bits makes ties go left and the minimum tell where it is.
    least = (gram & ~_U(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    have = 1
    while have < WIDTH:
        step = min(have, WIDTH - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & _U(0xFFFFFF)).astype(np.int64)
    ok = np.ones(len(anchor), bool)
    for e in ends[:-1].tolist():
        ok[max(0, e - SPAN + 1) : e] = False
    at = np.flatnonzero(ok)
    own = anchor[at]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
    count = np.diff(np.append(first, len(at)))
    start, place = at[first], own[first]
    digest = hashlib.blake2b
    spans = [] if seed else zip(start.tolist(), (start + count + SPAN - 1).tolist(), strict=True)
    digests = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in spans]) or bytes(16 * len(start))
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    piece = np.searchsorted(ends, start, side="right")
    starts, text, offset = ends - [len(x[2]) for x in pieces], np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces])
    return text[piece], start - starts[piece] + offset[piece], count, gram[place], halves[:, 0], halves[:, 1]


def tag_of(text: bytes) -> int:
    """Tells apart the texts of rows that repeat an id."""
    return zlib.crc32(text) & 0xFFFFFF


def row_of(text: bytes, null: bool) -> int:
    """Tells apart the rows of one id, together with the tag in 86 bits; those of null ids come last."""
    return null << 62 | xxhash.xxh64_intdigest(text, 29) >> 2


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    doc = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc, F.lit(NO_ID)).alias("doc"), text.alias("text"), doc.isNull().alias("null"))


def _rows_of(part: pa.RecordBatch) -> np.ndarray:
    return np.array([row_of(x, n) for x, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)], np.int64)


_ROWS = "h long, s long, t long, doc long, row long, pack long"
_KNOWN = -(2**63)  # added to the pack of a row that repeats another of its batch


def _combined(h: np.ndarray, s: np.ndarray, t: np.ndarray, doc: np.ndarray, row: np.ndarray, pack: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of a batch, sorted, with all but the first of a kind marked as known repeats.

    A known repeat needs no family: it goes to any task, so a string that occurs everywhere sends
    its own task a row for each batch and not for each occurrence.
    """
    order = np.lexsort((pack, row, doc, t, s, h))
    h, s, t, doc, row, pack = (x[order] for x in (h, s, t, doc, row, pack))
    kind = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1]))[: len(h)]
    lead = np.flatnonzero(kind)[np.cumsum(kind) - 1]
    known = ~kind & ((doc != doc[lead]) | (row != row[lead]) | (pack != pack[lead]))
    h[known] = _mixed((pack[known] ^ doc[known]).view(np.uint64)).view(np.int64)
    return h, s, t, doc, row, np.where(known, pack + _KNOWN, pack)


def _anchored(keyed: DataFrame) -> DataFrame:
    """(h, s, t, doc, row, pack): a row a segment; pack orders tag, start and holds the number of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                text, start, count, h, s, t = segment_rows(texts)
                tags = np.array([tag_of(x) for x in texts], np.int64)
                pack = tags[text] << 39 | start << 7 | count
                yield _batch(*_combined(h.view(np.int64), s.view(np.int64), t.view(np.int64), part.column(0).to_numpy()[text], _rows_of(part)[text], pack))

    return keyed.mapInArrow(run, _ROWS)


def _batch(*columns, names=("h", "s", "t", "doc", "row", "pack")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))


REPEAT, FIRST, HOT = 0, 1, 2  # what a row of events tells


def _sorted_out(rows: DataFrame) -> DataFrame:
    """(h, doc, row, pack, what): the repeats, the first of each string in a family of several, and a row HOT for a
    family of more than LARGE strings.

    Rows come sorted by h, s, t, doc, row, pack; one row is carried from batch to batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the latest first of a string: h, s, t, doc, row, pack, and the strings of its family so far
        names = ("h", "doc", "row", "pack", "what")

        def out(h, doc, row, pack, what):
            return _batch(h, doc, row, pack, np.full(len(h), what, np.int8), names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            h, s, t, doc, row, pack = (c.to_numpy() for c in batch.columns)
            told = pack < 0
            if told.any():
                yield out(h[told], doc[told], row[told], pack[told] - _KNOWN, REPEAT)
                h, s, t, doc, row, pack = (x[~told] for x in (h, s, t, doc, row, pack))
                if not len(h):
                    continue
            if held is not None:
                h, s, t, doc, row, pack = (np.append(a, b) for a, b in zip(held[:6], (h, s, t, doc, row, pack), strict=True))
            kind = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1]))
            at = np.flatnonzero(kind)
            lead = at[np.cumsum(kind) - 1]
            repeat = ~kind & ((doc != doc[lead]) | (row != row[lead]) | (pack != pack[lead]))
            fam = h[at]
            begins = np.flatnonzero(np.append(True, fam[1:] != fam[:-1]))
            sizes = np.diff(np.append(begins, len(at)))
            if held is not None:
                sizes[0] += held[6] - 1  # those of earlier batches; the carried one counts once
            size = np.repeat(sizes, np.diff(np.append(begins, len(at))))
            # The last string waits for the next batch, in which its family may go on.
            mixed = size > 1
            last = at[-1]
            firsts = at[:-1][mixed[:-1]]
            pick = np.flatnonzero(repeat)
            yield out(h[pick], doc[pick], row[pick], pack[pick], REPEAT)
            yield out(h[firsts], doc[firsts], row[firsts], pack[firsts], FIRST)
            done = begins[:-1][sizes[:-1] > LARGE]  # families that ended
            if len(done):
                yield out(fam[done], *[np.zeros(len(done), np.int64)] * 3, HOT)
            held = (h[last], s[last], t[last], doc[last], row[last], pack[last], int(sizes[-1]))
        if held is not None and held[6] > 1:
            yield out(*(np.array([held[i]]) for i in (0, 3, 4, 5)), FIRST)
            if held[6] > LARGE:
                yield out(np.array([held[0]]), *[np.zeros(1, np.int64)] * 3, HOT)

    dealt = rows.repartition(F.col("h")).sortWithinPartitions("h", "s", "t", "doc", "row", "pack")
    return dealt.mapInArrow(run, "h long, doc long, row long, pack long, what byte")


def _intervals(repeats: DataFrame) -> DataFrame:
    """(doc, row, tag, start, end) in bytes."""
    start = F.shiftright("pack", 7).bitwiseAND(F.lit(0xFFFFFFFF))
    return repeats.select("doc", "row", F.shiftright("pack", 39).alias("tag"), start.alias("start"), (start + F.col("pack").bitwiseAND(F.lit(127)) + SPAN - 1).alias("end"))


def _packed(keyed: DataFrame) -> DataFrame:
    """(doc, row, tag, blob): texts compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                yield _batch(part.column(0), _rows_of(part), [tag_of(x) for x in texts], [z.compress(x) for x in texts], names=("doc", "row", "tag", "blob"))

    return keyed.mapInArrow(run, "doc long, row long, tag long, blob binary")


def _fetched(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, doc, row, pack, segment): the text of each asked segment (h, doc, row, pack, hot) or, if hot, of each of its windows,
    under their digests.  A window that copies one of its batch is known: its pack is negative and it needs no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, size, seen = [], 0, {}
            for at in range(batch.num_rows):
                doc, row, blob, asks = (batch.column(i)[at].as_py() for i in range(4))
                text = z.decompress(blob)
                for x in asks:
                    start, count = x["pack"] >> 7 & 0xFFFFFFFF, x["pack"] & 127
                    if not x["hot"]:
                        rows.append((x["h"], doc, row, x["pack"], text[start : start + count + SPAN - 1]))
                        size += count + SPAN
                        continue
                    for i in range(start, start + count):
                        own, place = text[i : i + SPAN], (doc, row, x["pack"] >> 39 << 39 | i << 7 | 1)
                        first = seen.setdefault(own, place)
                        if first < place:
                            rows.append((0, doc, row, place[2] + _KNOWN, None))
                            continue
                        seen[own] = place  # the earlier of the two stands for both
                        rows.append((int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "big", signed=True), *place, own))
                        size += SPAN
                if size + 32 * len(rows) >= 8 << 20:
                    yield rows_of(rows)
                    rows, size = [], 0
                    seen = {} if len(seen) > 1 << 18 else seen
            yield rows_of(rows)

    def rows_of(rows: list) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 4, pa.binary())
        columns = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h", "doc", "row", "pack", "segment"])

    asks = asked.select("doc", "row", F.shiftright("pack", 39).alias("tag"), F.struct("h", "pack", "hot").alias("x")).groupBy("doc", "row", "tag").agg(F.collect_list("x").alias("asks"))
    texts = _packed(keyed).join(asks, ["doc", "row", "tag"]).select("doc", "row", "blob", "asks")
    return texts.mapInArrow(run, "h long, doc long, row long, pack long, segment binary")


def _packed_symbols(windows: list[bytes]) -> np.ndarray:
    """Windows of SPAN bytes as rows of numbers of PACKED bytes each, equal if and only if the windows are."""
    wide = -(-SPAN // PACKED)
    x = np.zeros((len(windows), wide * PACKED), np.int64)
    x[:, :SPAN] = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, SPAN)
    return x.reshape(len(windows), wide, PACKED) @ (256 ** np.arange(PACKED - 1, -1, -1))


def split(family: list[tuple[int, int, bytes]], seed: int = 1) -> tuple[list[list[tuple[int, int, bytes]]], list[tuple[int, int]]]:
    """A family of many strings as smaller ones, by other anchors, and the (doc, pack) of those that copy another.

    Equal windows have equal anchors, so they stay in one family.
    """
    if len(family) <= MIDDLE or seed > ROUNDS:
        return [family], []
    lanes: dict[int, dict[bytes, tuple[int, int]]] = {}
    repeats, out = [], []
    text, start, count, h, _, _ = segment_rows([x[2] for x in family], seed)
    for k, a, n, lane in zip(text.tolist(), start.tolist(), count.tolist(), h.tolist(), strict=True):
        doc, pack, seg = family[k]
        own = (doc, (pack & ~127) + (a << 7) | n)
        if lanes.setdefault(lane, {}).setdefault(seg[a : a + n + SPAN - 1], own) != own:
            repeats.append(own)
    for strings in lanes.values():
        if len(strings) > 1:
            more, copies = split([(*own, x) for x, own in strings.items()], seed + 1)
            out += more
            repeats += copies
    return out, repeats


def family_repeats(families: list[list[tuple[int, int, bytes]]]) -> list[tuple[int, int]]:
    """(doc, pack) runs of windows that repeat an earlier one; a family lists (doc, pack, segment) in order.

    Families of single windows are sorted by packed symbols, the others byte by byte.
    """
    single = [f for f in families if all(len(x[2]) == SPAN for x in f)]
    others = [f for f in families if any(len(x[2]) != SPAN for x in f)]
    return (_repeats(single, True) if single else []) + (_repeats(others, False) if others else [])


def _repeats(families: list[list[tuple[int, int, bytes]]], packed: bool) -> list[tuple[int, int]]:
    symbols, base, at_of = [], [0], []
    docs, packs = ([x[i] for f in families for x in f] for i in (0, 1))
    if packed:
        made = iter(np.unique(_packed_symbols([x[2] for f in families for x in f]), return_inverse=True)[1].reshape(len(docs), -1) + 2)
    span = -(-SPAN // PACKED) if packed else SPAN
    for family in families:
        for i, (_, _, seg) in enumerate(family):
            x = next(made) if packed else np.frombuffer(seg, np.uint8).astype(np.int64) + 2
            symbols += [x, np.array([0 if i == len(family) - 1 else 1])]
            at_of.append(len(x) + 1)
        base.append(base[-1] + sum(at_of[len(at_of) - len(family) :]))
    text = np.concatenate(symbols)
    sa = suffix_arrays(text, np.array(base))
    # Windows: places with a window's symbols left in their segment.
    start = np.cumsum(at_of) - at_of
    left = np.repeat(start + at_of - 1, at_of) - np.arange(len(text))
    rows = sa[left[sa] >= span]
    lane = np.searchsorted(np.array(base), rows, side="right")
    equal = np.zeros(len(rows), bool)
    for a in range(1, len(rows), 1 << 16):
        x, y = rows[a - 1 : a + (1 << 16) - 1], rows[a : a + (1 << 16)]
        x = x[: len(y)]
        same = (text[x] == text[y]) & (text[x + span - 1] == text[y + span - 1]) & (lane[a - 1 : a - 1 + len(y)] == lane[a : a + len(y)])
        k = np.flatnonzero(same)
        if len(k):
            each = np.arange(span)
            same[k] = (text[x[k][:, None] + each] == text[y[k][:, None] + each]).all(axis=1)
        equal[a : a + len(y)] = same
    group = np.cumsum(~equal)
    first = np.full(group[-1] + 1 if len(group) else 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, rows)
    repeats = np.sort(rows[rows != first[group]])
    if not len(repeats):
        return []
    cut = np.flatnonzero(np.append(True, np.diff(repeats) != 1))
    n = np.diff(np.append(cut, len(repeats)))
    seg = np.searchsorted(start, repeats[cut], side="right") - 1
    offset = repeats[cut] - start[seg]
    return [(docs[k], packs[k] >> 39 << 39 | (packs[k] >> 7 & 0xFFFFFFFF) + o << 7 | c) for k, o, c in zip(seg.tolist(), offset.tolist(), n.tolist(), strict=True)]


def _sorted_families(rows: DataFrame) -> DataFrame:
    """(doc, row, pack) of repeats inside families of segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[list[tuple]] = []
        family: list[tuple] = []  # ((doc, row), pack, segment)
        held, last = 0, None
        copies: list[tuple] = []

        def close() -> None:
            nonlocal held
            if len(family) > 1:
                parts, more = split(family) if len(family[0][2]) > SPAN or len(family[-1][2]) > SPAN else ([family], [])
                pool.extend(parts)
                copies.extend(more)
                held += sum(len(x[2]) for f in parts for x in f)

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal pool, held, copies
            if copies:
                yield told(copies)
                copies = []
            pool.sort(key=lambda f: sum(len(x[2]) for x in f))
            chunk, size = [], 0
            for f in pool:
                chunk.append(f)
                size += sum(len(x[2]) + 1 for x in f)
                if size >= SORTED_AT_ONCE:
                    yield from made(chunk)
                    chunk, size = [], 0
            if chunk:
                yield from made(chunk)
            pool, held = [], 0

        def made(chunk) -> Iterator[pa.RecordBatch]:
            if out := family_repeats(chunk):
                yield told(out)

        def told(found: list[tuple]) -> pa.RecordBatch:
            return _batch(*(pa.array(c, pa.int64()) for c in zip(*((*own, pack) for own, pack in found))), names=("doc", "row", "pack"))

        for batch in batches:
            for h, doc, row, pack, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != last:
                    close()
                    family, last = [], h
                    if held >= 4 * SORTED_AT_ONCE:
                        yield from found()
                if not family or family[-1][:2] != ((doc, row), pack):
                    family.append(((doc, row), pack, seg))
        close()
        yield from found()

    dealt = rows.select("h", "doc", "row", "pack", "segment").repartition(F.col("h")).sortWithinPartitions("h", "doc", "row", "pack")
    return dealt.mapInArrow(run, "doc long, row long, pack long")


def union_of(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals."""
    if not starts:
        return []
    order = np.argsort(np.array(starts), kind="stable")
    a, b = np.array(starts)[order], np.maximum.accumulate(np.array(ends)[order])
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return list(zip(a[first].tolist(), b[np.append(first[1:] - 1, len(a) - 1)].tolist(), strict=True))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, tag, start, end): byte intervals that go, in any order, overlaps included."""
    keyed = _keyed(docs, id_col, text_col)
    events = stored(_sorted_out(_anchored(keyed)), "segments")
    hot = events.where(F.col("what") == HOT).select("h", F.lit(True).alias("hot"))
    if hot.count() <= SMALL_TABLE:
        hot = F.broadcast(hot)
    asked = events.where(F.col("what") == FIRST).select("h", "doc", "row", "pack").join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    texts = stored(_fetched(keyed, asked), "families")
    repeats = events.where(F.col("what") == REPEAT).select("doc", "row", "pack")
    known = texts.where("segment IS NULL").select("doc", "row", (F.col("pack") - F.lit(_KNOWN)).alias("pack"))
    return _intervals(repeats.union(known).union(_sorted_families(texts.where("segment IS NOT NULL"))))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept (binary).

    A null text counts as empty.  A null id comes after all others.  Rows that repeat id and text
    are one document and get the same result; texts that differ under one id, or under null, are documents
    of their own, in the order of a digest.  Texts shorter than SPAN lose nothing.  An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, row, blob, cuts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = z.decompress(blob)
                    spans = union_of([x["start"] for x in cuts or ()], [x["end"] for x in cuts or ()])
                    edges = [0, *(y for x in spans for y in x), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((None if row >> 62 else doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else []))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=schema.fieldNames())

    cuts = repeated_spans(docs, id_col, text_col).groupBy("doc", "row", "tag").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    texts = _packed(_keyed(docs, id_col, text_col)).join(cuts, ["doc", "row", "tag"], "left").select("doc", "row", "blob", "cuts")
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if with_text else [])])
    return texts.mapInArrow(run, schema)
