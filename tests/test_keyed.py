"""Keyed tables and the profiles kept in them."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from sigloom.operators import features
from sigloom.operators.keyed import KeyedTable, Profiles
from sigloom.sources.adapter import normalized_events
from sigloom.storage import work_path


def table(spark, **kept):
    return KeyedTable(spark, work_path(spark, "keyed"), "k string, g long, n long, at timestamp", ["k", "g"], **{"parts": 8, "buckets": 4, **kept})


def test_upserts_match_a_dictionary(spark):
    t, want, rng = table(spark), {}, random.Random(2)
    for turn in range(4):
        rows = {(rng.choice("abcdefgh"), rng.randrange(12)): rng.randrange(100) for _ in range(40)}
        new = spark.createDataFrame([(*k, n) for k, n in rows.items()], "k string, g long, n long").withColumn("at", F.timestamp_seconds(F.lit(turn)))
        t.upsert(new, {"n": F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))})
        for k, n in rows.items():
            want[k] = (want.get(k, (0, 0))[0] + n, turn)
    got = {(r.k, r.g): (r.n, r.at) for r in t.rows().select("k", "g", "n", F.unix_seconds("at").alias("at")).collect()}
    assert got == want and t.rows().columns == ["k", "g", "n", "at"]
    assert t.upsert(new.limit(0)) == []
    again = KeyedTable(spark, t.path, t.columns, t.keys, parts=8, buckets=4)  # another name over the same files
    assert again.rows().count() == len(want)


def test_the_stored_side_is_not_shuffled_and_only_touched_partitions_are_rewritten(spark):
    t = table(spark)
    t.upsert(spark.range(400).selectExpr("cast(id AS string) AS k", "id AS g", "id AS n", "timestamp_seconds(id) AS at"))
    few = spark.range(2).selectExpr("cast(id AS string) AS k", "id AS g", "-id AS n", "timestamp_seconds(id) AS at")
    parts = t.touched(few)
    assert 0 < len(parts) <= 2
    plan = t.merged(few, {}, parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Bucketed: true" in plan
    below = plan[plan.index("FileScan") :]
    assert "PartitionFilters" in below and str(parts[0]) in below
    files = lambda: {str(p) for p in Path(t.path).rglob("*.parquet")}
    before = files()
    assert t.upsert(few) == parts
    gone, new = before - files(), files() - before
    assert {p.split("part=")[1].split("/")[0] for p in gone | new} == {str(p) for p in parts} and t.rows().count() == 400
    assert {tuple(r) for r in t.rows().where("g < 3").select("k", "n").collect()} == {("0", 0), ("1", -1), ("2", 2)}


def test_increments_equal_a_recomputation(spark, sf):
    rows = features.minute_rollup(normalized_events(spark, sf))
    kept = Profiles(spark, work_path(spark, "profiles"), parts=8, buckets=4, time="timestamp_ntz")
    n = 5
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64(F.lit(1), F.col("bin_start")), F.lit(n)) == i)
        kept.add(part, f"run{i}")
        if i == 2:
            kept.add(part, f"run{i}")  # repeated: changes nothing
    for compat in (features.DEFAULT, features.Compat(top_n=2)):
        got, want = kept.profiles(compat), features.profiles(rows, compat)
        assert got.count() == want.count() > 5 and got.select(*want.columns).exceptAll(want).count() == 0
    touched = kept.add(rows.where("entity_id = 'host_1'").limit(1), "more")
    assert len(touched["stats"]) == 1
