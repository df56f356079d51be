"""Incidents: an ordered fold of signals over each entity.

Signals come in order of their window's end.  One joins the entity's incident if that was
updated in the last 30 minutes and started in the last 4 hours; otherwise it founds a new one.
In this order only the newest incident can match, so the fold's state is one incident.  No incident spans a
gap of over 30 minutes, so each entity's signals are cut into sessions there, by a window function; sessions are
dealt and folded each on its own, and a signal without neighbours founds its incident without a fold.

Over several runs the incidents are a table: a run seeds its fold with the open ones (:func:`assign`, ``table``) and gives the
rows that it changes (:func:`changed`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

GAP_MINUTES = 30  # fixed values
CAP_HOURS = 4
SCORE_CAP = 50
OPEN = ["NEW", "ACTIVE"]  # statuses of incidents that take signals


def candidates(table: DataFrame, signals: DataFrame) -> DataFrame:
    """(entity_type, entity_id, open): of each entity that has signals its open incidents (last, start, id) in micros, latest first.

    An incident that starts no later than another and was last updated no later is never chosen; so beside the entity's latest only
    those that started after it are listed.
    """
    entity = ["entity_type", "entity_id"]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    made = F.struct(micros("last_update_time").alias("last"), micros("start_time").alias("start"), F.col("incident_id").alias("id")).alias("x")
    able = table.where(F.col("status").isin(OPEN)).select(F.col("root_entity_type").alias("entity_type"), F.col("root_entity_id").alias("entity_id"), made)
    able = able.join(signals.select(*entity).distinct(), entity, "left_semi")
    newest = able.groupBy(*entity).agg(F.max("x").alias("m"))
    kept = able.join(newest, entity).where("x.start > m.start OR x = m")
    return kept.groupBy(*entity).agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("open"))


def assign(signals: DataFrame, id_col: str = "dedupe_key", gap_minutes: int = GAP_MINUTES, cap_hours: int = CAP_HOURS, table: DataFrame | None = None) -> DataFrame:
    """``signals`` with incident_id (the founding signal's id, or an open incident's of ``table``) and founder.  Equal ends go by id.

    Open incidents of earlier runs take signals as those of this run do, the latest first; as in a lookup, one that was
    updated after the signal's end takes it too.  Sessions stay independent of one another: what an earlier session does to
    an open incident moves its last update to a time that is out of reach for the next.
    """
    gap, cap = gap_minutes * 60_000_000, cap_hours * 3_600_000_000
    columns = signals.columns
    keyed = signals.withColumns({"__s": F.unix_micros(F.col("window_start").cast("timestamp")), "__e": F.unix_micros(F.col("window_end").cast("timestamp"))})
    order = Window.partitionBy("entity_type", "entity_id").orderBy("__e", id_col)
    opens = F.coalesce(F.col("__e") - F.lag("__e").over(order) > gap, F.lit(True))
    # A session is named by the end and the id of its first signal.
    first = F.when(opens, F.struct(F.col("__e").alias("e"), F.col(id_col).alias("id")))
    sessions = keyed.withColumn("__session", F.xxhash64("entity_type", "entity_id", F.last(first, True).over(order)))
    continued = table is not None
    if continued:
        sessions = sessions.join(candidates(table, signals).withColumnRenamed("open", "__open"), ["entity_type", "entity_id"], "left")
    dealt = sessions.repartition("__session").sortWithinPartitions("__session", "entity_type", "entity_id", "__e", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, able = None, []  # incidents (start, last, id) that may take the next signal, latest last
        for batch in batches:
            session = batch.column("__session").to_numpy()
            ids, founders = batch.column(id_col).to_pylist(), [True] * batch.num_rows
            same = np.append(False, session[1:] == session[:-1])[: len(session)]
            # Rows alone in their session are done; the batch's ends may go on in its neighbours.
            open_ = batch.column("__open") if continued else None
            seeded = False if open_ is None else open_.is_valid().to_numpy(zero_copy_only=False)
            todo = np.flatnonzero(same | np.append(same[1:], True) | seeded | (np.arange(len(session)) == 0))
            got = (batch.column(c).take(pa.array(todo)).to_pylist() for c in ("__session", "entity_type", "entity_id", "__s", "__e", id_col))
            for at, *own, s, e, key in zip(todo.tolist(), *got, strict=True):
                if entity != own:
                    entity = own
                    able = [] if open_ is None else [(x["start"], x["last"], x["id"]) for x in reversed(open_[at].as_py() or ())]
                # Ends only grow: one that is out of reach stays so.
                while able and not (able[-1][1] >= e - gap and able[-1][0] >= e - cap):
                    able.pop()
                founders[at] = not able
                if able:
                    able[-1] = (able[-1][0], max(able[-1][1], e), able[-1][2])
                else:
                    able = [(s, e, key)]
                ids[at] = able[-1][2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(ids, pa.string()), pa.array(founders, pa.bool_())], names=[*columns, "incident_id", "founder"])

    schema = signals.schema.add("incident_id", "string").add("founder", "boolean")
    return dealt.mapInArrow(run, schema)


def incidents(assigned: DataFrame) -> DataFrame:
    """A row an incident: founder's title, start and full score; each other signal adds at most 50."""
    founder = F.col("founder")
    score = F.sum(F.when(founder, F.col("score")).otherwise(F.least(F.col("score"), F.lit(float(SCORE_CAP)))))
    return assigned.groupBy("incident_id").agg(
        F.max(F.when(founder, F.concat("signal_name", F.lit(" on "), "entity_id"))).alias("title"),
        F.lit("NEW").alias("status"),
        F.max("severity").alias("severity"),
        score.alias("score"),
        F.max("entity_type").alias("root_entity_type"),
        F.max("entity_id").alias("root_entity_id"),
        F.max(F.when(founder, F.col("window_start"))).alias("start_time"),
        F.max("window_end").alias("end_time"),
        F.max("window_end").alias("last_update_time"),
    )


def changed(table: DataFrame, assigned: DataFrame) -> DataFrame:
    """The rows of incidents that ``assigned`` founds or adds to, as they are after it: those of ``table`` brought up to date.

    Others of ``table`` stay as they are.  An incident keeps its title, status, entity and start.
    """
    new = incidents(assigned).alias("new")
    old = table.join(assigned.select("incident_id").distinct(), "incident_id", "left_semi").alias("old")
    kept = {c: F.coalesce(f"old.{c}", f"new.{c}") for c in ("title", "status", "root_entity_type", "root_entity_id", "start_time")}
    grown = {c: F.greatest(f"old.{c}", f"new.{c}") for c in ("severity", "end_time", "last_update_time")}
    made = kept | grown | {"score": F.coalesce("old.score", F.lit(0.0)) + F.col("new.score")}
    return new.join(old, "incident_id", "left").select("incident_id", *[c.alias(name) for name, c in made.items()]).select(*new.columns)


def empty_table(signals: DataFrame) -> DataFrame:
    """A table of no incidents, with the types that those of ``signals`` have."""
    return incidents(signals.limit(0).withColumns({"incident_id": F.lit(""), "founder": F.lit(True)}))


def evidence(assigned: DataFrame, id_col: str = "dedupe_key") -> DataFrame:
    return assigned.select("incident_id", F.col(id_col).alias("signal_id")).distinct()
