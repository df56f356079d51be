"""Searches through the index give the same rows as a scan, and read only the parts that can have some."""

import re

from pyspark.sql import functions as F

from sigloom.operators import serve
from sigloom.operators.textindex import TextIndex
from sigloom.plans import rollups
from sigloom.sources.adapter import normalized_events
from sigloom.storage import work_path


def parts_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []
    def walk(p):
        if "FileScan" in p.nodeName() or p.nodeName().startswith("Scan parquet"):
            m = p.metrics()
            if m.contains("numPartitions"):
                found.append(m.apply("numPartitions").value())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        if hasattr(p, "executedPlan") and "Adaptive" in p.nodeName():
            walk(p.executedPlan())
        if "QueryStage" in p.nodeName():
            walk(p.plan())
    walk(plan)
    return found


def test_same_rows_and_few_parts(spark, sf):
    events = rollups.tagged(spark, sf).withColumn("raw", F.concat_ws(" ", "raw", F.concat(F.lit("user=U"), "raw_id", F.lit(".Ä"))))
    index = TextIndex(spark, work_path(spark, "indexed"), blocks=4)
    index.add(events)
    for words in (["host_1", "host_3"], ["user=U77."], ["user=u77."], ["U12", "LAB_HOST=host_2 end"], ["7.Ä"], ["="], [" end"], ["nowhere"]):
        got, want = index.find(words), serve.find_text(events, words, ["raw_id"])
        assert sorted(r.raw_id for r in got.collect()) == sorted(r.raw_id for r in want.collect())
    assert index.find(["x"]).columns == events.columns
    everything = parts_read(index.find(["="]))
    one = parts_read(index.find(["user=U77."]))
    # Folders are pruned by dates and by blocks, each on its own.
    assert everything[0] > 60 and 0 < index.parts(["user=U77."]).count() <= one[0] <= 12
    assert index.parts(["="]) is None


def test_dates_and_a_second_load(spark, sf):
    events = rollups.tagged(spark, sf)
    index = TextIndex(spark, work_path(spark, "indexed"), blocks=2)
    early, late = F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date")
    index.add(events.where(F.col("event_time") < early))
    index.add(events.where(F.col("event_time") >= early))
    day = events.where(F.to_date("event_time") == early)
    index.add(day)  # a date anew
    want = events.where(F.col("raw").contains("host_1") & (F.to_date("event_time") >= early) & (F.to_date("event_time") <= late))
    got = index.find(["host_1"], early, late)
    assert sorted(r.raw_id for r in got.collect()) == sorted(r.raw_id for r in want.collect()) and want.count() > 5
    assert index.find(["x"]).count() == events.where(F.col("raw").contains("x")).count()
