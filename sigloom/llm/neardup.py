"""Near-duplicates at a similarity of word shingles, by multi-index hashing of wide SimHash prints.

Documents of one set of shingles are one node.  A node's print is a run of segments and two check words,
all SimHash bits of its shingles.  Nodes meet where a segment differs in at most one bit, or in one
bit of each side: each is put under its segment and under the half of its Hamming ball of radius
one that sets a bit.  Nodes that meet and agree in all but ``CHECK`` of the check bits are candidates, and a candidate is
a link if the sets of shingles themselves are similar enough.

The length of a segment follows the number of documents, so that a bucket holds about as many strangers at any
size; the number of segments follows from it, so that the share of pairs that meet (``RECALL``, for a pair right at
the threshold) is the same too.  It grows as about the sixth root of the number of documents.

Every pair of candidates is verified, or lies in one group by other links.  A large group isn't paired: first each node tries
its ``PARTNERS`` nearest under each of its segments alone, which groups near copies at a tenth of the rows of the balls.  Then each row
of a bucket tries as many of other groups, and of those pairs the nearest between each two groups, so that the balls of a group list none of its pairs
and few with others; and after that, of the nodes that have more candidates than those, once more.
From then on those whose sizes or parities prove them unlike aren't candidates: an element of one set alone flips one bit of ``parity``, so two
parities never differ in more bits than the sets in elements.  What is left are candidates in different groups that no try has joined; both of
them have candidates that weren't tried, so that only such nodes are dealt to buckets again; their pairs are listed, all of them, and verified once each.  So the pairs grow with the rows of buckets and with candidates just below the threshold, not with the square of a group of copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sigloom.llm.common import map_rows, stored
from sigloom.llm.components import components
from sigloom.llm.simhash import shingles

WIDTH = 5  # words of a shingle
SIMILAR = 0.8  # Jaccard similarity of the sets of shingles
RECALL = 0.95  # of pairs right at SIMILAR, by the buckets
CHECKS = 2  # check words of 64 bits
CHECK = 33  # of their bits that a candidate may differ in; at SIMILAR 19 do, five in ten thousand pairs more than 33
PARTNERS = 2  # that a row of a bucket tries first
NEXT, TURNS = 48, 3  # rows that a row is compared with for those, by its order in a bucket, and orders; all, in a bucket of 49
LARGE = 4096  # rows of a bucket in one task; of more, those of its largest group are dealt on
PARITY = 512, 8192  # bits of a set's parity, at least two an element, and at most; with fewer than two it rules out less, never more
MORE = -1  # stands in place of a partner where a node has more candidates than it tries


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def meeting(bits: int, similar: float = SIMILAR) -> float:
    """The share of pairs of a similarity that meet in one segment of so many bits."""
    p = math.acos(2 * similar / (1 + similar)) / math.pi  # that a bit differs, of sets of equal size
    q = 1 - p
    return q**bits + bits * p * q ** (bits - 1) + bits * (bits - 1) / 4 * p**2 * q ** (bits - 2)


def layout(documents: int) -> tuple[int, int]:
    """(bits of a segment, segments) for so many documents."""
    bits = max(8, math.ceil(math.log2(max(2, documents))) + 1)
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meeting(bits)))


def load(documents: int) -> float:
    """Rows of a bucket, if no document is like another."""
    bits, _ = layout(documents)
    return documents * (1 + bits / 2) / 2**bits


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, sorted."""
    digest = xxhash.xxh64_intdigest
    grams = set(shingles(text, width))
    return np.sort(np.fromiter((digest(x, 42) for x in grams), np.uint64, len(grams)))


def parity(found: np.ndarray) -> bytes:
    """For each bit, whether an odd number of a set's hashes falls on it; a power of two of bits, so that halves fold by XOR."""
    least, most = PARITY
    m = min(most, max(least, 1 << (2 * len(found) - 1).bit_length())) if len(found) else least
    odd = np.bincount((found & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differing(parities: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Elements that at least are in one of the sets u and v alone, by their parities; longer ones are folded to the shorter one's length."""
    words = np.array([len(x) // 8 for x in parities], np.int64)
    short, out = np.minimum(words[u], words[v]), np.zeros(len(u), np.int64)
    for m in np.unique(short).tolist():
        mine = np.flatnonzero(short == m)
        rows, place = np.unique(np.concatenate([u[mine], v[mine]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, m), axis=0) for x in parities[rows]])
        for at in range(0, len(mine), 1 << 14):
            i, j = place[: len(mine)][at : at + (1 << 14)], place[len(mine) :][at : at + (1 << 14)]
            out[mine[at : at + (1 << 14)]] = np.bitwise_count(folded[i] ^ folded[j]).sum(axis=1)
    return out


def _admitting(n: np.ndarray, parities: np.ndarray | None, least: float):
    """A function that keeps of places i and j those whose sets may be similar, by their sizes n and, if given, parities."""
    words = PARITY[0] // 64
    folded = np.array([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, words), axis=0) for x in parities]).reshape(-1, words) if parities is not None else None

    def run(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[ok], j[ok]
        # The shortest parities first, which cost least.
        for differing in (lambda: np.bitwise_count(folded[i] ^ folded[j]).sum(axis=1), lambda: _differing(parities, i, j)):
            if folded is not None and len(i):
                ok = differing() <= (1 - least) / (1 + least) * (n[i] + n[j]) + 1e-6
                i, j = i[ok], j[ok]
        return i, j

    return run


def node_print(found: np.ndarray, bits: int, segments: int) -> tuple[int, int, list[int], list[int], int]:
    """(both halves of the node's name, check words, segments, size) of a set of shingles; a segment holds its own number above its bits."""
    per = 64 // bits
    words = -(-segments // per) + CHECKS
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(found), 65536):
        h = found[at : at + 65536]
        for k in range(words):
            own = _mixed(h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)).astype(">u8")
            ones[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    w = [int(x) for x in np.packbits(2 * ones > len(found), axis=1).view(">u8")[:, 0]]
    cut = [w[CHECKS + s // per] >> s % per * bits & (1 << bits) - 1 | s << bits for s in range(segments)]
    name = xxhash.xxh3_128_intdigest(found.tobytes(), 7)
    signed = lambda x: x - (x >> 63 << 64)
    return signed(name >> 64), signed(name & 2**64 - 1), [signed(x) for x in w[:CHECKS]], cut, len(found)


def _buckets(nodes: DataFrame, bits: int, *more: str) -> DataFrame:
    """(bucket, node, c0, c1 and ``more``): each node under its segments and under the upper halves of their balls."""
    columns = ["node", "c0", "c1", *more]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                segs = part.column(0).flatten().to_numpy().reshape(part.num_rows, -1)
                rows, keys = [], []
                everyone = np.arange(part.num_rows)
                for key in segs.T:
                    rows.append(everyone)
                    keys.append(key)
                    for b in range(bits):
                        low = np.flatnonzero((key >> b & 1) == 0)
                        rows.append(low)
                        keys.append(key[low] | 1 << b)
                pick = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(c.take(pick) for c in part.columns[1:])], names=["bucket", *columns])

    rows = nodes.select("segs", *columns)
    return rows.mapInArrow(run, "bucket long, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns))


def _apart(check: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Check bits in which rows i and j differ; ``check`` has a row for each word."""
    return np.bitwise_count(check[:, i] ^ check[:, j]).sum(axis=0, dtype=np.int16)


def _nearest(keys: np.ndarray, check: np.ndarray, group: np.ndarray | None, radius: int, may=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (u, v): for each row its PARTNERS nearest rows of its bucket and another group, within ``radius`` and kept by ``may``; and
    the rows that may have more candidates.

    Rows come sorted by bucket.  In a bucket of up to NEXT + 1 rows all are compared; in a larger one each with its
    neighbours in TURNS orders, by the first check word turned, so that the work is linear.
    """
    n = len(keys)
    best, whom = np.full((PARTNERS, n), radius + 1, np.int16), np.full((PARTNERS, n), -1, np.int64)
    met = np.zeros(n, np.int64)

    def offer(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        """b as a partner of a: each a occurs once."""
        met[a] += d <= radius
        ok = (d < best[-1, a]) & (whom[:, a] != b).all(axis=0)
        a, b, d = a[ok], b[ok], d[ok]
        best[-1, a], whom[-1, a] = d, b
        for k in range(PARTNERS - 1, 0, -1):
            up = a[best[k, a] < best[k - 1, a]]
            for x in (best, whom):
                x[k, up], x[k - 1, up] = x[k - 1, up], x[k, up].copy()

    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, np.int64)
    size = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    for turn in range(TURNS):
        rows = np.flatnonzero(size > (NEXT + 1 if turn else 1))
        if not len(rows):
            break
        if turn:
            by = np.uint64(64 * turn // TURNS)
            rows = rows[np.lexsort((check[0, rows] << by | check[0, rows] >> np.uint64(64) - by, keys[rows]))]
        k, at = keys[rows], np.arange(len(rows))
        for step in range(1, NEXT + 1):
            at = at[at + step < len(rows)]
            at = at[k[at] == k[at + step]]
            if not len(at):
                break
            i, j = rows[at], rows[at + step]
            if group is not None:
                other = group[i] != group[j]
                i, j = i[other], j[other]
            d = _apart(check, i, j)
            if may:
                near = d <= radius
                i, j = may(i[near], j[near])
                d = _apart(check, i, j)
            offer(i, j, d)
            offer(j, i, d)
    found = whom >= 0
    return np.nonzero(found)[1], whom[found], np.flatnonzero((met > PARTNERS) | (size > NEXT + 1))


def _across_parts(keys: np.ndarray, check: np.ndarray, group: np.ndarray, radius: int, may=None, most: int | None = None, over: np.ndarray | None = None):
    """Parts of the places (u, v) of a bucket, of different groups, within ``radius`` and kept by ``may``.  Rows come sorted by bucket.

    A bucket of more than ``most`` rows is left out, and marked in ``over``, unless its rows outside its largest group are so few that
    comparing them takes no more than a bucket of ``most`` rows does.
    """
    n = len(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settled() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return may(i, j) if may else (i, j)

    def look(i: np.ndarray, j: np.ndarray) -> None:
        other = group[i] != group[j]
        i, j = i[other], j[other]
        near = _apart(check, i, j) <= radius
        held.append((i[near], j[near]))

    at = np.flatnonzero(np.repeat(size, size) <= NEXT + 1)
    end = np.repeat(first + size, size)
    for step in range(1, NEXT + 1):
        at = at[at + step < end[at]]
        if not len(at):
            break
        look(at, at + step)
    big = size > NEXT + 1
    for a, m in zip(first[big].tolist(), size[big].tolist(), strict=True):
        # Rows of the bucket's largest group have no pairs among them, and aren't compared.
        names, of = np.unique(group[a : a + m], return_inverse=True)
        lead = names[np.bincount(of).argmax()]
        others = a + np.flatnonzero(group[a : a + m] != lead)
        whole = a + np.flatnonzero(group[a : a + m] == lead)
        if most and m > most and len(others) * m > most**2:
            over[a : a + m] = True
            continue
        for k, i in enumerate(others.tolist()):
            j = np.concatenate([whole, others[k + 1 :]])
            look(np.full(len(j), i), j)
            if len(held) >= 256:
                yield settled()
    if held:
        yield settled()


def _across(keys: np.ndarray, check: np.ndarray, group: np.ndarray, radius: int, may=None) -> tuple[np.ndarray, np.ndarray]:
    """All places (u, v) of a bucket, of different groups, within ``radius`` and kept by ``may``.  Rows come sorted by bucket."""
    found = list(_across_parts(keys, check, group, radius, may))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _of_groups(keys: np.ndarray, check: np.ndarray, group: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places (u, v) the nearest pair of each two groups of a bucket: rows of a large group don't each list what is near it."""
    u, v = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
    by = keys[u], np.minimum(group[u], group[v]), np.maximum(group[u], group[v])
    order = np.lexsort((_apart(check, u, v), *by))
    changes = np.any([np.diff(x[order]) != 0 for x in by], axis=0)
    first = order[np.append(True, changes)] if len(u) else order
    return u[first], v[first]


def _by_bucket(dealt: DataFrame, keys: list[str], links, names: str) -> DataFrame:
    """``links(columns)`` of the rows of whole buckets; ``dealt`` comes sorted by ``keys``.  A task holds one bucket and one batch."""
    def run(batches):
        held: list[list[np.ndarray]] = []  # parts of the bucket that the next batch may go on with

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            changes = np.any([np.diff(c) != 0 for c in columns[: len(keys)]], axis=0)
            last = int(np.flatnonzero(changes)[-1]) + 1 if changes.any() else 0
            goes_on = held and all(h[0] == c[0] for h, c in zip(held[0], columns[: len(keys)], strict=False))
            if held and (last or not goes_on):
                if goes_on:
                    yield links([np.concatenate(c) for c in zip(*held, [c[:last] for c in columns], strict=True)])
                else:
                    yield links([np.concatenate(c) for c in zip(*held, strict=True)])
                    if last:
                        yield links([c[:last] for c in columns])
                held = []
            elif last:
                yield links([c[:last] for c in columns])
            held.append([c[last:] for c in columns])
        if held:
            yield links([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.mapInArrow(run, names)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(u, v), u > v, each once."""
    once = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["u", "v"])


def _pairs_and_more(a: np.ndarray, b: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """(u, v, more), u > v, each once: 1 in ``more`` if u is in ``rest``, 2 if v is; nodes of ``rest`` without a pair have MORE in place of v."""
    pairs, rest = _pairs(a, b), np.unique(rest)
    u, v = (c.to_numpy() for c in pairs.columns)
    alone = rest[~np.isin(rest, np.concatenate([u, v]))]
    u, v = np.concatenate([u, alone]), np.concatenate([v, np.full(len(alone), MORE)])
    more = np.isin(u, rest) + 2 * np.isin(v, rest)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, more.astype(np.int32))], names=["u", "v", "more"])


def candidates(nodes: DataFrame, bits: int, radius: int = CHECK, across: str | None = None, least: float = SIMILAR, large: int = LARGE) -> DataFrame:
    """(u, v), u > v: nodes (node, c0, c1, segs), numbers from 0, and the nearest that they meet, within ``radius``; and (node, MORE) for
    nodes that may have more.

    Given the column ``across``, candidates are different in it and, where ``nodes`` has sizes n and parities, may be similar by them; then MORE
    is told exactly but for buckets of more than ``large`` rows of several groups: a candidate that isn't listed has it at both ends.
    With 0 ``bits`` nodes meet by equal segments only, and MORE isn't told.
    """
    more = [across, *(c for c in ("n", "parity") if c in nodes.columns)] if across else []

    def links(columns):
        keys, node, c0, c1, *rest = columns
        check, given = np.stack([c0, c1]).view(np.uint64), dict(zip(more, rest, strict=True))
        may = _admitting(given["n"], given.get("parity"), least) if "n" in given else None
        u, v, rest = _nearest(keys, check, given.get(across), radius, may)
        if across:
            u, v = _of_groups(keys, check, given[across], u, v)
            met, over = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            for part in _across_parts(keys, check, given[across], radius, may, large, over):
                met += np.bincount(np.concatenate(part), minlength=len(keys))
            rest = np.flatnonzero(over | (met > np.bincount(np.concatenate([u, v]), minlength=len(keys))))
        return _pairs_and_more(node[u], node[v], node[rest] if bits else node[:0])

    dealt = _buckets(nodes, bits, *more).repartition(F.col("bucket")).sortWithinPartitions("bucket", "node")
    made = _by_bucket(dealt, ["bucket"], links, "u long, v long, more int").groupBy("u", "v").agg(F.bit_or("more").alias("more"))
    told = [F.when(F.col("more").bitwiseAND(k) > 0, F.struct(F.col(x).alias("u"), F.lit(MORE).cast("long").alias("v"))) for k, x in ((1, "u"), (2, "v"))]
    return made.select(F.inline(F.array_compact(F.array(F.struct("u", "v"), *told)))).distinct()


def _first_bucket(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """The one bucket, of all that two nodes with segments x and y share, in which the pair counts; a row a pair."""
    only = np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)
    first = ((only[0] <= 1) & (only[1] <= 1)).argmax(axis=1)
    at = np.arange(len(x))
    return x[at, first] | y[at, first]


def every_candidate(nodes: DataFrame, bits: int, radius: int = CHECK, large: int = LARGE, least: float = SIMILAR) -> DataFrame:
    """(u, v), u > v: all nodes (node, c0, c1, segs, g, n) that meet within ``radius``, have different g and sets that may be similar, by
    their sizes n and, where ``nodes`` has them, their parities.

    A pair counts in the first bucket that it shares, so it is listed once.  Of a bucket of more than ``large`` rows those of its
    largest g, which have no pairs among them, are dealt on, each part with all others.
    """
    def packed(batches):
        for batch in batches:
            segs = [x.astype("<i8").tobytes() for x in batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segs, pa.binary())], names=[*names, "print"])

    odd = [c for c in nodes.columns if c == "parity"]
    names = ["segs", "node", "c0", "c1", "g", "n", *odd]
    types = "segs array<long>, node long, c0 long, c1 long, g long, n long, " + "".join(f"{c} binary, " for c in odd)
    whole = nodes.select(*names).mapInArrow(packed, f"{types}print binary")
    sizes = _buckets(nodes, bits, "g").groupBy("bucket", "g").count().groupBy("bucket").agg(F.sum("count").alias("rows"), F.max(F.struct("count", "g")).alias("x"))
    # A bucket of one g has no pairs.
    sizes = sizes.where(F.col("rows") > F.col("x.count")).select("bucket", F.col("x.g").alias("lead"), F.ceil(F.col("rows") / large).cast("long").alias("parts"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")))
    part = F.when(F.col("g") == F.col("lead"), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = _buckets(whole, bits, "g", "n", "print", *odd).join(sizes, "bucket")
    dealt = rows.select("bucket", F.explode(part).alias("part"), "node", "c0", "c1", "g", "n", (F.col("g") == F.col("lead")).cast("long").alias("led"), "print", *odd)

    def links(columns):
        bucket, part, node, c0, c1, g, n, led, prints, *parities = columns
        keys = np.cumsum(np.append(0, (np.diff(bucket) != 0) | (np.diff(part) != 0)))[: len(bucket)]
        u, v = _across(keys, np.stack([c0, c1]).view(np.uint64), g, radius, _admitting(n, parities[0] if parities else None, least))
        # Rows that lie in every part have their pairs in the first.
        ok = (led[u] + led[v] > 0) | (part[u] == 0)
        u, v = u[ok], v[ok]
        kept = []
        for at in range(0, len(u), 1 << 14):
            i, j = u[at : at + (1 << 14)], v[at : at + (1 << 14)]
            x, y = (np.frombuffer(b"".join(prints[k].tolist()), "<i8").reshape(len(k), -1) for k in (i, j))
            kept.append(_first_bucket(x, y, bits) == bucket[i])
        here = np.concatenate(kept) if kept else np.zeros(0, bool)
        return _pairs(node[u[here]], node[v[here]])

    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")
    return _by_bucket(dealt, ["bucket", "part"], links, "u long, v long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(u, v, linked): whether the sets (node, set) of a pair have at least this Jaccard similarity."""
    a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "uv")
    both = F.size(F.array_intersect("set_u", "set_v"))
    linked = both >= F.lit(least) * (F.size("set_u") + F.size("set_v") - both) - 1e-9
    return pairs.join(a, "u").join(b, "v").select("u", "v", linked.alias("linked"))


def _salted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("salt"), F.col(text_col).alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the wanted (id, salt, node), a stored table."""
    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                blobs = [z.compress(x.encode("utf-8", "surrogatepass")) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())], names=["id", "salt", "blob"])

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [shingle_set(z.decompress(x), width).view(np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "set"])

    packed = _salted(docs, id_col, text_col).where("text IS NOT NULL").mapInArrow(pack, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("salt", T.LongType()), T.StructField("blob", T.BinaryType())]))
    w = wanted.select(F.col("id").alias("wid"), F.col("salt").alias("wsalt"), "node")
    met = packed.join(w, F.col("id").eqNullSafe(F.col("wid")) & (F.col("salt") == F.col("wsalt"))).select("node", "blob")
    return stored(met.mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]), "sets")


def grouped(docs: DataFrame, width: int = WIDTH, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, x, component): the nodes of ``docs``, each with the first (n, id, salt) of its rows and its group; a stored table.

    Rows of equal sets of shingles are one node; null and empty texts, and others without a word, have the empty set.  Of
    ``docs`` only the two columns are read.  Nodes are numbered; sets are told apart by 128 bits.
    """
    bits, segments = layout(docs.count())

    def make():
        def run(texts):
            sets = [shingle_set(None if x is None else x.encode("utf-8", "surrogatepass"), width) for x in texts]
            made = [(*node_print(x, bits, segments), parity(x)) for x in sets]
            return {n: [x[i] for x in made] for i, n in enumerate(("high", "low", "checks", "segs", "n", "parity"))}

        return run

    # Texts stay where they are until the rows to compare or to keep are known.
    fields = [*(T.StructField(n, T.LongType()) for n in ("high", "low")), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("checks", "segs")), T.StructField("n", T.LongType()), T.StructField("parity", T.BinaryType())]
    rows = map_rows(_salted(docs, id_col, text_col), make, fields, ["id", "salt"], "text")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "salt"))
    known = rows.groupBy("high", "low").agg(F.first("checks").alias("checks"), F.first("segs").alias("segs"), F.first("n").alias("n"), F.first("parity").alias("parity"), first.alias("x"))
    words = [F.get("checks", F.lit(k)).alias(f"c{k}") for k in range(CHECKS)]
    nodes = stored(known.select(F.monotonically_increasing_id().alias("node"), *words, "segs", "n", "parity", "x"), "nodes")

    def sets_of(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """``known`` and the sets of all other nodes that ``found`` names."""
        ends = found.select(F.col("u").alias("node")).union(found.where(F.col("v") != MORE).select(F.col("v").alias("node"))).distinct()
        ends = ends.join(known.select("node"), "node", "left_anti") if known else ends
        made = _sets(docs, nodes.join(ends, "node").select("node", "x.id", "x.salt"), width, id_col, text_col)
        return known.union(made) if known else made

    found = stored(candidates(nodes, 0), "candidates")
    sets = sets_of(found)
    tried = stored(similar(found, sets, least), "tried")
    group = stored(components(tried.where("linked").select("u", "v")), "groups")
    rest = nodes.select("node", "c0", "c1", "segs")
    for k, step in enumerate((
        lambda x: candidates(x, bits, across="g"),
        lambda x: candidates(x, bits, across="g", least=least),
        lambda x: every_candidate(x, bits, least=least),
    )):
        # The nearest of other groups; of nodes that have more, once more; then, of those that still have, all that are in different groups.
        named = stored(rest.join(group, "node", "left").select(*rest.columns, F.coalesce("component", "node").alias("g")), "named")
        found = stored(step(named), "candidates")
        sets = sets if k else sets_of(found, sets)
        more = found.where(F.col("v") == MORE).select(F.col("u").alias("node"))
        rest = stored(nodes.select("node", "c0", "c1", "segs", "n", "parity").join(more, "node"), "rest")
        new = stored(found.where(F.col("v") != MORE).join(tried.select("u", "v"), ["u", "v"], "left_anti"), "untried")
        tried = tried.union(stored(similar(new, sets, least), "tried"))
        group = stored(components(tried.where("linked").select("u", "v")), "groups")
        if rest.isEmpty():
            break
    return stored(nodes.join(group, "node", "left").select("node", "x", F.coalesce("component", "node").alias("component")), "grouped")


def deduplicated(docs: DataFrame, width: int = WIDTH, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of its smallest id, a null id last.

    Null and empty texts are copies of one another.  Rows that repeat id and text are one; rows that repeat an id go by
    their own texts.  A text of fewer than ``width`` words is one shingle.  An empty table gives an empty result.
    """
    best = grouped(docs, width, least, id_col, text_col).groupBy("component").agg(F.min("x").alias("x"))
    kept = best.select(F.col("x.id").alias("__id"), F.col("x.salt").alias("__salt"))
    joined = docs.withColumn("__s", F.xxhash64(text_col)).join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__s") == F.col("__salt")))
    once = Window.partitionBy("__id", "__salt").orderBy(F.lit(0))  # rows that repeat id and text are one
    return joined.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)
