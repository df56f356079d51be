import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sigloom.llm import suffix_dedup

DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, span=100):
    """Brute force over (doc_id, bytes), ids unique."""
    seen, out = set(), {}
    for doc, b in sorted(rows):
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            if s in seen:
                gone[i : i + span] = b"\x01" * span
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs).drop("kept").collect()}


def test_small_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc", F.lit("clash")).withColumn("h", F.lit(1))
    want = plain([(r.doc_id, r.text.encode()) for r in docs.select("doc_id", "text").collect()])
    got = result(docs)
    assert got == want and sum(x[1] for x in want.values()) > 100_000


@pytest.mark.parametrize("large", [512, 3])
def test_odd_texts(spark, large, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, copy = text(60), text(200)
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 5000), (6, "y" * 100 + "x" * 101), (7, "ab" * 700), (8, "ba" * 60)]
    rows += [(20 + i, text(rng.randint(0, 25)) + shared + text(rng.randint(0, 25))) for i in range(70)]
    rows += [(100 + i, copy) for i in range(9)]
    rows += [(200 + i, copy[: rng.randint(50, 900)] + word() + copy[rng.randint(0, 900) :]) for i in range(40)]
    rows += [(300, shared * 5), (301, "\n".join([text(20)] * 6))]
    docs = spark.createDataFrame([(a, b, None, "x") for a, b in rows], DOCS).repartition(5)
    assert result(docs) == plain([(a, (b or "").encode()) for a, b in rows])


def test_repeated_and_null_ids(spark):
    a, b = "".join(map(chr, range(40, 120))) * 2, "z" * 150
    rows = [(3, a, None, None)] * 3 + [(None, a, None, None), (4, b, None, None), (4, b[:120], None, None)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id != 4} == {(3, 0 + len(a) - len(a[:160])), (None, 160)} or {r.n_removed for r in got if r.doc_id == 3} == {plain([(3, a.encode())])[3][1]}
    assert suffix_dedup.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    b = bytes(random.Random(1).randrange(256) for _ in range(5000))
    text, start, count, h, s, t = suffix_dedup.segment_rows([b, b[:99], b[1000:2500]])
    own = sorted((int(a), int(n)) for t, a, n in zip(text, start, count) if t == 0)
    assert own[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(own, own[1:])) and sum(own[-1]) == 4901
    assert max(count) <= suffix_dedup.WIDTH and set(text.tolist()) == {0, 2}


def test_families_by_brute_force(monkeypatch):
    rng = random.Random(6)
    called = []
    arrays = suffix_dedup.suffix_arrays
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda *a: called.append(len(a[1]) - 1) or arrays(*a))
    for lengths in ((100,), (100, 101, 130, 168)):
        families = []
        for _ in range(60):
            parts = [bytes(rng.choice(b"ab") for _ in range(rng.choice(lengths))) for _ in range(3)]
            own = [(d, d << 7 | 1, rng.choice(parts)) for d in range(rng.randint(2, 9))]
            families.append([(d, p & ~127 | len(x) - 99, x) for d, p, x in own])
        got = set()
        for doc, pack in suffix_dedup.family_repeats([[(k * 100 + d, p, x) for d, p, x in f] for k, f in enumerate(families)]):
            got |= {(doc, (pack >> 7 & 0xFFFFFFFF) + i) for i in range(pack & 127)}
        want = set()
        for k, f in enumerate(families):
            seen = set()
            for d, p, x in f:
                for i in range(len(x) - 99):
                    if x[i : i + 100] in seen:
                        want.add((k * 100 + d, (p >> 7) + i))
                    seen.add(x[i : i + 100])
        assert got == want and want
    assert called == [60, 60] or sum(called) == 120


def test_splitting_a_family_loses_no_repeat(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MIDDLE", 5)
    rng = random.Random(9)
    part = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    core, left, right = part(60), [part(40) for _ in range(6)], [part(40) for _ in range(6)]
    family = [(d, 1000 << 7 | 41, rng.choice(left) + core + rng.choice(right)) for d in range(80)]
    lanes, copies = suffix_dedup.split(family)
    assert len(lanes) > 1 and copies
    got = {(d, (p >> 7) + i) for d, p in copies + suffix_dedup.family_repeats(lanes) for i in range(p & 127)}
    seen, want = set(), set()
    for d, _, x in family:
        for i in range(len(x) - 99):
            if x[i : i + 100] in seen:
                want.add((d, 1000 + i))
            seen.add(x[i : i + 100])
    assert got == want


def test_null_and_repeated_ids_with_equal_tags(spark):
    """10 000 texts without an id, and some of one id, among them texts of one tag: each is a document of its own."""
    rng = random.Random(17)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(40)]
    texts = [rng.choice(shared)[: rng.choice([150, 150, 120])] + f" {i:x} " + "".join(rng.choice("xyz") for _ in range(rng.choice([5, 60, 200]))) for i in range(10_000)]
    by_tag = {}
    for x in texts + [shared[0] + f"{i:x}" + shared[1] for i in range(9000)]:
        by_tag.setdefault(suffix_dedup.tag_of(x.encode()), []).append(x)
    clashes = [x for same in by_tag.values() if len(same) > 1 for x in same]
    assert len(clashes) >= 4
    for ids in (lambda i: None, lambda i: 7):
        rows = [(ids(i), x, None, None) for i, x in enumerate(dict.fromkeys(texts + clashes))] + [(2**63 - 1, shared[2], None, None), (5, shared[3], None, None)]
        late = ids(0) is None
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, suffix_dedup.row_of(r[1].encode(), late)))
        want = plain([(k, r[1].encode()) for k, r in enumerate(order)])
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS).repartition(6)).collect())
        assert got == sorted((r[0] is None, r[0] or 0, *want[k]) for k, r in enumerate(order))
