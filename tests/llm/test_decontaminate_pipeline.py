import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import decontaminate, langid, mixing, neardup, secrets
from tests.llm.test_neardup import plain_groups

DOCS = "doc_id long, text string, lang string, source string"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], max(row[j], row[j - 1], prev + 1) if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(65, 70)]) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert decontaminate.lcs(a, b)[0] == plain_lcs(a, b)


def test_svd_finds_the_leading_space(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 12)) @ rng.normal(size=(12, 90))
    rows = [(k, list(range(90)), [float(x) for x in r]) for k, r in enumerate(a)]
    v = decontaminate.randomised_svd(spark.createDataFrame(rows, "k long, at array<long>, w array<double>"), 90, 12)
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-8) and np.allclose(a @ v @ v.T, a, atol=1e-6)


def holds(text, item):
    """Brute force: every span of words against the item."""
    w, x = decontaminate.words_of(text), decontaminate.words_of(item)
    return bool(x) and any(w[i : i + len(x)] == x for i in range(len(w) - len(x) + 1))


def test_exact_leaks_match_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if holds(r.text, t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.withColumn("item_id", F.lit("clash")), bench).collect()}
    assert got == want and len(want) > 20


def test_exact_leaks_of_many_items(spark):
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    cuts = [" ".join(w[i : i + 40]) for w in texts for i in range(0, len(w) - 39, 40)]
    cuts = list(dict.fromkeys(cuts))
    for n in (500, 2000):
        items = list(enumerate(cuts[:n]))
        hosts = [w.split() for w in cuts[n : n + 200]]
        leaked = items[:: n // 200][:200]
        rows = [(k, " ".join([*hosts[j][:20], t, *hosts[j][20:]]), "en", "x") for j, (k, t) in enumerate(leaked)]
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
        assert {(k, k) for k, _ in leaked} <= got


def test_leaks_in_a_third_of_all_rows(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    items += [(9000 + n, " ".join(items[n][1].split()[: n + 1])) for n in range(6)]  # of one to six words
    hosts = [r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    rows = []
    for n, w in enumerate(hosts):
        at = len(w) // 2 + n % 16
        leaked = [t for _, t in items] if n % 3 == 0 else []
        rows.append((n, " ".join([*w[:at], *(x for k, t in enumerate(leaked) for x in [t, *w[k : k + 30]]), *w[at:]]), "en", "x"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, i) for d, text, *_ in rows for i, t in items if holds(text, t)} <= got


def said_in(text, item):
    """Brute force: every span of words, as wide as an item may be spread, against the whole item."""
    w, x = decontaminate.words_of(text), decontaminate.words_of(item)
    width = int(len(x) * decontaminate.SPAN) + 2
    for s in range(len(w)):
        n, answer = decontaminate.lcs(x, w[s : s + width])
        if n >= decontaminate.COPIED * len(x) or (n >= decontaminate.PARAPHRASED * len(x) and answer >= decontaminate.ANSWER * decontaminate.answer_size(len(x)) and len(x) >= 8):
            return True
    return False


def test_recall_of_paraphrases(spark):
    """Words replaced outside the answer: what brute force finds is found; at 38 % the answer decides."""
    d = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.orderBy("item_id").collect()]
    hosts = [r.text.split() for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect() if not any(holds(r.text, t) for _, t in items)]
    rng, rows, planted = random.Random(5), [], {}
    for share in (0.2, 0.3, 0.38):
        for n, (item, text) in enumerate(items):
            w = text.split()
            ahead = len(w) - len(w) // 4
            for k in rng.sample(range(ahead), min(ahead, round(share * len(w)))):
                w[k] = "zz" + w[k][::-1]
            host = hosts[len(rows) % len(hosts)]
            at = len(host) // 2
            planted[len(rows)] = (share, item, text)
            rows.append((len(rows), " ".join([*host[:at], *w, *host[at:]]), "en", "x"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    for share in (0.2, 0.3, 0.38):
        want = {(k, item) for k, (s, item, text) in planted.items() if s == share and said_in(rows[k][1], text)}
        assert len(want) >= 15 and len(want & got) >= 0.9 * len(want), share
    assert all(said_in(rows[k][1], dict(items)[i]) for k, i in got)


def test_items_count_whole_and_every_span_counts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    long, short = [word() for _ in range(4000)], [word() for _ in range(40)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(long[:2001]) + " of it")], "item_id long, text string")
    filler = [word() for _ in range(400)]
    most = [word() if i < 14 else x for i, x in enumerate(short)]  # 0.65 of the item, with its answer
    beginning = short[:30]  # 0.75 of it, without
    rows = [(10, " ".join(long[:2000])), (11, " ".join([*filler, *long])), (12, " ".join([*long[:3300], "x"])), (13, " ".join(long[1990:2100])), (14, " ".join([*filler, *beginning, *filler, *most, *filler])), (15, " ".join([*filler, *beginning])), (16, "of it")]
    docs = spark.createDataFrame([(a, b, "en", "x") for a, b in rows], DOCS)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(10, 3), (11, 1), (11, 3), (12, 1), (12, 3), (14, 2)}
    assert 0.6 <= got[14, 2].covered < 0.7 and got[14, 2].answer == 1


def test_paraphrases_and_odd_rows(spark, sf):
    rng = random.Random(8)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.orderBy("item_id").collect()]
    other = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if not any(holds(r.text, t) for _, t in items)]
    rows, want = [(i, t, "en", "x") for i, t in enumerate(other)], set()
    for n, (item, text) in enumerate(items):
        w = text.split()
        said = [rng.choice(["quite", "new", "words"]) if rng.random() < 0.2 and k < 0.75 * len(w) else x.upper() for k, x in enumerate(w)]
        host = other[n].split()
        at = len(host) // 2
        rows.append((1000 + n, " ".join([*host[:at], *said, *host[at:]]), "en", "x"))
        want.add((1000 + n, item))
    rows += [(5000, None, None, None), (5001, "", "en", "x"), (5002, " ".join(t for _, t in items[:5]) + "\n" + "filler " * 20_000, "en", "x"), (1000, other[0], "en", "x")]
    want |= {(5002, i) for i, _ in items[:5]}
    odd = spark.createDataFrame([(None, "x y"), (77, None), (78, ""), (79, "!!")], "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench.union(odd).union(bench.limit(3))).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 1
    assert decontaminate.contaminated(docs, odd).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({d for d, _ in got})


def test_stages_do_what_they_say(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.work_path(spark, name)
        stage(spark, after[-1].withColumn("score", F.lit("clash")).withColumn("fp", F.lit(1)), d).write.parquet(path)
        after.append(spark.read.parquet(path))
    assert all(x.columns == corpus_pipeline.COLUMNS for x in after[:-1])
    texts = [{r.doc_id: r.text for r in x.collect()} for x in after]
    # 1: exactly those recognised
    marks = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert set(texts[1]) == {k for k, r in marks.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert len(texts[1]) > 0.97 * len(texts[0])
    # 2: one, the smallest id, of each group; brute force over shingle sets removes no less of what goes
    groups, pairs = plain_groups(texts[1])
    want = {k for k in texts[1] if groups.find(k) == k}
    gone = len(texts[1]) - len(want)
    assert want <= set(texts[2]) and len(texts[2]) - len(want) <= 0.05 * gone and gone > 50
    assert sum(a in texts[2] and b in texts[2] for a, b in pairs) <= 0.05 * len(pairs)
    # 3: none holds a benchmark item
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert set(texts[3]) == {k for k, t in texts[2].items() if not any(holds(t, x) for x in items)}
    # 4: all stay, without their secrets
    assert set(texts[4]) == set(texts[3])
    found = {k: secrets.scan([t])[0] for k, t in texts[3].items()}
    assert {k for k in found if found[k]} == {k for k in found if texts[3][k] != texts[4][k]} != set()
    assert not any(secrets.scan([t])[0] for t in texts[4].values())
    # 5: every document once at least, sources within the limit
    rows = after[5].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in rows} == set(texts[4]) and max(r["count"] for r in rows) <= np.ceil(mixing.REPETITIONS)


def test_stages_of_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the of and", "en", "a", 10), (3, "the of and", "en", "a", 10), (4, "the of and", None, None, None), (5, "word " * 30_000, "en", "b", 1), (None, "and so on of it", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS + ", n_chars long").withColumn("held_out", F.lit("clash")).withColumn("epoch", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert stage(spark, docs, sf).count() >= 3
    one = neardup.deduplicated(docs.drop("held_out", "epoch")).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "3", "5", "None"]
    assert neardup.deduplicated(spark.createDataFrame([(None, "a b", None, None)] * 2, DOCS)).count() == 1
