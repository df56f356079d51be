"""Predicates that reach the server, ranges of a stream, and the sink that inserts once."""

import json
import sqlite3
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sigloom.sources.export import SearchExport, _StreamReader
from sigloom.sources.store import KeyedStore

AT = datetime(2025, 1, 1, tzinfo=timezone.utc).timestamp()


def logged_transport(search, start, end):
    """An event every ten seconds; the server compares fields without regard to case, and logs what it was asked."""
    with open("/tmp/sigloom-searches", "a") as f:
        f.write(json.dumps([search, start, end]) + "\n")
    for i in range(int(-(-start // 10)), int(-(-end // 10))):
        yield json.dumps({"result": {"_time": str(i * 10), "host": ["web", "WEB", "db"][i % 3], "index": "main"}})


@pytest.fixture
def asked():
    open("/tmp/sigloom-searches", "w").close()
    return lambda: [json.loads(x) for x in open("/tmp/sigloom-searches")]


def test_predicates_become_search_text(spark, asked):
    spark.dataSource.register(SearchExport)
    key = "spark.sql.python.filterPushdown.enabled"
    old = spark.conf.get(key)
    options = {"transport": f"{__name__}:logged_transport", "search": "search index=* | fields *", "start": str(AT), "end": str(AT + 6000), "splits": "3", "fields": "_time,host,index"}
    low, high = (F.lit(datetime.fromtimestamp(AT + x, timezone.utc)) for x in (600, 1200))
    found = []
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            rows = spark.read.format("search_export").options(**options, pushdown=on).load()
            kept = rows.where((F.col("_time") >= low) & (F.col("_time") <= high) & (F.col("host") == "web") & F.col("index").isin("main", "other"))
            found.append(sorted(r.event for r in kept.select("event").collect()))
    finally:
        spark.conf.set(key, old)
    assert found[0] == found[1] and len(found[0]) == 21
    seen = asked()
    narrow = [x for x in seen if "host=" in x[0]]
    assert len(narrow) == 3 and {x[0] for x in narrow} == {'search index=* (index="main" OR index="other") host="web" | fields *'}
    assert min(x[1] for x in narrow) == AT + 600 and AT + 1200 < max(x[2] for x in narrow) < AT + 1201
    assert len([x for x in seen if x[0] == "search index=* | fields *"]) == 3


def test_a_stream_has_bounded_ranges():
    r = _StreamReader({})
    assert abs(r.initialOffset()["at"] - time.time()) < 60  # without a start it begins now, not in 1970
    parts = r.partitions({"at": 0.0}, {"at": 1.7e9})
    assert len(parts) == 256 and parts[0].start == 0 and parts[-1].end == 1.7e9 and all(a.end == b.start for a, b in zip(parts, parts[1:]))
    assert len(r.partitions({"at": 0.0}, {"at": 150.0})) == 3 and r.partitions({"at": 5.0}, {"at": 5.0}) == []
    late = _StreamReader({"lag": "100", "start": "3"})
    assert late.initialOffset() == {"at": 3.0} and abs(late.latestOffset()["at"] - time.time() + 100) < 60
    assert len(_StreamReader({"limit": "5"}).partitions({"at": 0.0}, {"at": 1000.0})) == 1


def connect_to(path):
    return sqlite3.connect(path, timeout=60)


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(KeyedStore)
    path = str(tmp_path / "db")
    with connect_to(path) as db:
        db.execute("CREATE TABLE raw (event_key TEXT PRIMARY KEY, n INTEGER, at TEXT)")
    return {"connect": f"{__name__}:connect_to", "database": path, "table": "raw", "keys": "event_key"}


def rows_in(options, table="raw"):
    with connect_to(options["database"]) as db:
        return sorted(db.execute(f"SELECT * FROM {table}").fetchall())


def test_batches_insert_or_update(spark, store):
    one = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "event_key string, n long, at string").repartition(2)
    for _ in range(2):
        one.write.format("keyed_store").options(**store).mode("append").save()
    assert rows_in(store) == [("a", 1, "x"), ("b", 2, None)]
    two = spark.createDataFrame([("b", 9, "y"), ("c", 3, "z")], one.schema)
    two.write.format("keyed_store").options(**store).mode("append").save()
    assert rows_in(store) == [("a", 1, "x"), ("b", 2, None), ("c", 3, "z")]
    two.write.format("keyed_store").options(**store, update="true").mode("append").save()
    assert rows_in(store) == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, "z")]
    assert rows_in(store, "raw_staged") == []


def test_a_failed_write_leaves_nothing(spark, store):
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("k"), "id").alias("event_key"), "id", F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise("x").alias("at")).withColumnRenamed("id", "n")
    with pytest.raises(Exception):
        rows.write.format("keyed_store").options(**store).mode("append").save()
    assert rows_in(store) == [] and rows_in(store, "raw_staged") == []


def test_a_repeated_batch_of_a_stream_counts_once(spark, store, tmp_path):
    """A batch whose commit the checkpoint lost is run again; the store knows it, even where keys would not tell."""
    with connect_to(store["database"]) as db:
        db.execute("CREATE TABLE log (event_key TEXT, n INTEGER, at TEXT)")
    options = {**store, "table": "log", "keys": "", "query": "q"}
    for i in range(3):
        spark.createDataFrame([(f"k{i}{j}", j, "x") for j in range(5)], "event_key string, n long, at string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("event_key string, n long, at string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def run():
        q = source.writeStream.format("keyed_store").options(**options).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None

    run()
    assert len(rows_in(options, "log")) == 15
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))
    for p in [commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")]:
        p.unlink(missing_ok=True)  # as if the driver had died after the store's commit
    run()
    assert len(rows_in(options, "log")) == 15 and rows_in(options, "log_staged") == []
