import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigloom.llm import licenses, mixing
from sigloom.llm.license_texts import SPELLINGS, TEXTS

DOCS = "doc_id long, text string, lang string, source string"


def test_whole_licence_texts(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(TEXTS):
        rows += [
            (10 * i, text, "en", "a"),
            (10 * i + 1, "Copyright (c) 2001-2020 Some Body <a@b.c>\n\n" + text.upper(), "en", "a"),
            (10 * i + 2, "  " + text.replace(" ", "\r\n").replace("license", "licence") + "!!", None, None),
            (10 * i + 3, text + " And more.", "en", "a"),
        ]
        want |= {10 * i: name, 10 * i + 1: name, 10 * i + 2: name, 10 * i + 3: None}
    rows += [(901, None, None, None), (902, "", "en", "a"), (903, "Copyright 2020 x", "en", "a"), (904, "ä" * 200_000, "en", "a"), (904, "MIT License\n\n" + TEXTS[0][1], "en", "a")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("license", F.lit("clash")).withColumn("text_digest", F.lit(1))
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.license for r in got if r.doc_id < 900} == want
    odd = [r for r in got if r.doc_id in (901, 902, 903)]
    assert len({r.text_digest for r in odd}) == 1 and {r.license for r in odd} == {None}
    assert sorted(str(r.license) for r in got if r.doc_id == 904) == ["MIT", "None"]
    assert licenses.license_scan(docs.limit(0)).count() == 0


def plain_canonical(text):
    """The canonical form by tokens: spellings one after another, each from the left."""
    import regex

    lines = [x for x in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n") if not re.match(r"[^\p{L}]*(copyright|\(c\)|©).*(\(c\)|©|[0-9]{4}|all rights reserved|<|\[)".replace(r"\p{L}", "a-zA-Zé"), x, re.I)]
    t = regex.sub(licenses._TITLE, "", "\n".join(lines).lower())
    words = regex.findall(r"[\p{L}\p{N}]+", t)
    for a, b in SPELLINGS:
        a, b, out, i = a.split(), b.split(), [], 0
        while i < len(words):
            hit = words[i : i + len(a)] == a
            out += b if hit else [words[i]]
            i += len(a) if hit else 1
        words = out
    return " ".join(words)


def test_canonical_form(spark):
    texts = ["the licence licence text", "Sub licence, sub-licence SUBLICENCE", "copyright owner copyright owner owner", "", None, "non infringement non\ninfringement", "licence" * 3, "x licence", "© 2020 A\nlicence\r\rlicence", "(c) 1999 <b>\n  \nMIT License\n", "Whilst wilful judgement, whilst wilful"] + [t for _, t in TEXTS]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", licenses.canonical(F.col("t")).alias("c")).collect()
    for r in rows:
        assert r.c == plain_canonical(texts[r.i]), texts[r.i]


def test_digests_of_long_licences(spark):
    """Where the system has the licence texts, their digests are those listed, and a doctored copy has none."""
    folder = Path("/usr/share/common-licenses")
    have = [(name, (folder / file).read_text("utf-8", "replace")) for name, file in FILES.items() if (folder / file).exists()]
    if not have:
        pytest.skip("no licence texts here")
    docs = spark.createDataFrame([(i, change(t), None, None) for i, (_, t) in enumerate(have) for change in (str, str.upper, lambda x: re.sub(r"\blicense\b", "licence", x).replace("\n", "\r\n"))] + [(-1, have[0][1] + " more", None, None)], DOCS)
    got = licenses.license_scan(docs).collect()
    assert all(r.license == (have[r.doc_id][0] if r.doc_id >= 0 else None) for r in got) and len(got) == 3 * len(have) + 1


FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_notices(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.union(spark.createDataFrame([(900, "x\r\n RELEASED under the MIT licence \nLicensed under CC BY-NC 4.0.", None, None)], DOCS))
    names = {"released under the mit license.": "MIT", "licensed under the apache license, version 2.0.": "Apache-2.0", "this work is licensed under the gnu general public license, version 3.": "GPL-3.0", "licensed under cc by-nc 4.0.": "CC-BY-NC-4.0"}
    want = {r.doc_id: ",".join(sorted({names[x.lower()] for x in r.text.split("\n") if x.lower() in names})) for r in docs.collect()}
    want[900] = "CC-BY-NC-4.0,MIT"
    assert {r.doc_id: r.notices for r in licenses.license_scan(docs).collect()} == want
    assert sum(map(bool, want.values())) > 2


def covering_budget(tokens, weights):
    return max(tokens[k] / weights[k] for k in tokens)


def test_exponent():
    tokens = {"a": 9e6, "b": 1e6, "c": 5e4}
    total = sum(tokens.values())
    x = mixing.fit_exponent(tokens, repetitions=2.0)
    w = mixing.weights_at({k: v / total for k, v in tokens.items()}, x)
    whole = covering_budget(tokens, w)
    assert 0 < x < 1 and math.isclose(max(w[k] * whole / tokens[k] for k in tokens), 2.0, rel_tol=1e-6)
    y = mixing.fit_exponent(tokens, target_entropy=0.9)
    assert math.isclose(mixing.entropy(mixing.weights_at({k: v / total for k, v in tokens.items()}, y)), 0.9, rel_tol=1e-6)
    assert mixing.fit_exponent({"a": 1.0, "b": 1.0}, 2.0) == 0.0


@pytest.mark.parametrize("options", [{}, {"budget": 40_000.0, "repetitions": 3.0}, {"target_entropy": 2.9}])
def test_mixture(spark, sf, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source"))).withColumn("tokens", F.lit("clash")).withColumn("block", F.lit(0))
    size = {r.doc_id: (r.source, len(r.text.split())) for r in docs.collect()}
    sums = Counter()
    for s, n in size.values():
        sums[s] += n
    rows = mixing.mix(docs, block_tokens=2000, **options).collect()
    took, streams = Counter(), defaultdict(list)
    for r in rows:
        assert r.tokens == size[r.doc_id][1] and r.source == size[r.doc_id][0]
        took[r.source] += r.tokens
        streams[r.source, r.epoch].append(r)
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    x = mixing.fit_exponent({k: float(v) for k, v in sums.items()}, options.get("repetitions", mixing.REPETITIONS), options.get("target_entropy"), options.get("budget"))
    w = mixing.weights_at({k: v / sum(sums.values()) for k, v in sums.items()}, x)
    whole = options.get("budget") or covering_budget(sums, w)
    longest = Counter()
    for s, n in size.values():
        longest[s] = max(longest[s], n)
    for s in sums:
        assert whole * w[s] - 1e-6 <= took[s] <= whole * w[s] + longest[s] + 1e-6
        full = took[s] // sums[s]
        assert all(len(streams[s, e]) == sum(x[0] == s for x in size.values()) for e in range(int(full)))
    assert all(abs(r.weight - w[r.source]) < 1e-9 for r in rows)
    if not options:
        assert {r.doc_id for r in rows if r.epoch == 0} == set(size)


@pytest.mark.parametrize("options", [{}, {"budget": 30_000.0, "repetitions": 3.0}])
def test_documents_taken_match_a_plain_permutation(spark, sf, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    got = Counter((r.doc_id, r.epoch) for r in mixing.mix(docs, block_tokens=1500, **options).collect())
    salt, spans = F.xxhash64("doc_id", "text"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("epoch")
    rows = docs.select("doc_id", "source", F.xxhash64(F.lit(42), "doc_id", salt).alias("g"), salt.alias("salt"), F.size(F.split(F.trim("text"), r"\s+")).alias("n"), spans).withColumn("place", F.xxhash64(F.lit(43), "epoch", "doc_id", "salt")).collect()
    sizes, counts = Counter(), Counter()
    for r in rows:
        if r.epoch == 0:
            sizes[r.source] += r.n
            counts[r.source] += 1
    x = mixing.fit_exponent({k: float(v) for k, v in sizes.items()}, options.get("repetitions", mixing.REPETITIONS), None, options.get("budget"))
    w = mixing.weights_at({k: v / sum(sizes.values()) for k, v in sizes.items()}, x)
    whole = options.get("budget") or covering_budget(sizes, w)
    blocks = {k: max(1, -(-v // 1500), -(-counts[k] // mixing.BLOCK_DOCUMENTS)) for k, v in sizes.items()}
    named = spark.range(max(blocks.values())).select(F.col("id").alias("g"), spans).withColumn("b", F.xxhash64(F.lit(42), "epoch", "g")).collect()
    order = {(r.epoch, r.g): r.b for r in named}
    want = Counter()
    for source, size in sizes.items():
        ahead = 0
        for epoch in range(6):
            own = [(order[epoch, r.g % blocks[source]], r.place, r.doc_id, r.n) for r in rows if r.source == source and r.epoch == epoch]
            for _, _, doc, n in sorted(own):
                if ahead < w[source] * whole - 1e-6:
                    want[doc, epoch] += 1
                ahead += n
    assert got == want


def test_prefix_sums_of_many_sources(spark):
    rows = [(i, "a b c", "en", f"host{i % 700}") for i in range(2800)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), budget=4200.0, block_tokens=3).groupBy("source").count().collect()
    assert len(got) == 700 and {r["count"] for r in got} == {2}


def test_mixture_of_odd_rows(spark):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (3, "one two", None, "a"), (3, "one two", None, "a"), (4, " \t\n", "en", "b"), (None, "three", "en", None), (5, "word " * 50_000, "en", "c")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).where("epoch = 0").collect()
    assert sorted((str(r.doc_id), r.tokens) for r in got) == sorted((str(a), len((b or "").split())) for a, b, _, _ in rows)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, "a")], DOCS)).count() == 1


def test_lines_are_chosen_by_their_first_word(spark):
    """A line may start with another spelling of a notice's first word, in any case and behind any signs; with an empty notice every line counts."""
    notices = [("A", "Sublicense of this is granted."), ("B", "Analyze me"), ("C", "Ärger über ΣΑΣ")]
    lines = ["// SUB LICENCE, of this is granted", "sublicence of this is granted!", "  * analyse ME.", "analyser me", "äRGER ÜBER σας", "x analyze me", "", "Analyze me too"]
    docs = spark.createDataFrame([(i, x, None, None) for i, x in enumerate(lines)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.notices for r in licenses.license_scan(docs, notices=notices).collect()}
    assert got == {0: "A", 1: "A", 2: "B", 3: "", 4: "C", 5: "", 6: "", 7: ""}
    assert licenses.first_words(["sublicense of"]) == {"sublicense", "sub", "sublicence"} and licenses.first_words(["a", ""]) is None
    got = licenses.license_scan(docs, notices=[("E", "--")]).where("notices = 'E'").collect()
    assert [r.doc_id for r in got] == [6]
    assert licenses.license_scan(docs, notices=[]).where("notices <> ''").count() == 0
