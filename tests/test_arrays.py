"""Large JSON arrays in ranges, against the parser of whole texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sigloom.sources.arrays import array_events


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}

    def to(size):
        for k, v in keys.items():
            spark.conf.set(k, v or str(size))

    yield to
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(['a', '"', "\\", ",", "[", "]", "{", "}", " ", "\n", "é", "\\u0041", ':', "\\\""]) for _ in range(rng.randrange(14)))
    if kind < 5:
        return rng.choice([1, 2.5, None, True, -7])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [64, 900])
def test_ranges_match_the_parser(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    want = []
    for n in range(3 if size == 64 else 6):
        events = [{"n": n, "i": i, "x": value(rng)} for i in range(9 if size == 64 else rng.choice([0, 1, 2, 25, 60]))] + [7, "a,b", [1, 2]][: rng.randrange(4)]
        rng.shuffle(events)
        shape = n % 3
        text = json.dumps(events, ensure_ascii=bool(n % 2), indent=rng.choice([None, 1]))
        text = ["", "\ufeff", " \n"][n % 3] + (text if shape else '{"results" : ' + text + rng.choice(["}", ', "more": [{"a": 1}, "]"]}']))
        (tmp_path / f"f{n}.json").write_text(text, encoding="utf-8")
        want += [(f"f{n}.json", json.dumps(x, sort_keys=True)) for x in events if isinstance(x, dict)]
    (tmp_path / "other.json").write_text('{"a": [1, 2], "b": 3}')
    small_ranges(size)
    got = [(r.path.rsplit("/", 1)[1], json.dumps(json.loads(r.event), sort_keys=True)) for r in array_events(spark, str(tmp_path / "*.json")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 25
    if size == 64:
        ranges = spark.read.option("lineSep", ",").text(str(tmp_path / "*.json")).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert ranges > 20


def test_a_long_element_over_many_ranges(spark, tmp_path, small_ranges):
    long = {"t": ["x,y\"]" * 40] * 30, "k": 1}
    (tmp_path / "a.json").write_text(json.dumps([{"k": 0}, long, {"k": 2}]))
    small_ranges(100)
    got = [json.loads(r.event) for r in array_events(spark, str(tmp_path / "a.json")).collect()]
    assert sorted(got, key=lambda x: x["k"]) == [{"k": 0}, long, {"k": 2}]


def test_a_large_array_of_one_line(spark, tmp_path):
    """Thirty megabytes in one line: several tasks read it, none has it whole."""
    one = json.dumps([{"i": i, "text": "a, \"quoted\" [word] " * 60} for i in range(24_000)])
    (tmp_path / "big.json").write_text(one)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        events = array_events(spark, str(tmp_path / "big.json"))
        ids = events.select(F.get_json_object("event", "$.i").cast("int").alias("i"), F.length("event").alias("n"))
        row = ids.agg(F.countDistinct("i").alias("d"), F.count("*").alias("c"), F.sum("i").alias("s")).first()
        parts = spark.read.option("lineSep", ",").text(str(tmp_path / "big.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (row.d, row.c, row.s) == (24_000, 24_000, sum(range(24_000))) and parts >= 7
