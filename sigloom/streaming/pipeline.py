"""The streaming twin: normalized events and windowed features; :mod:`sigloom.streaming.detect` goes on from there.

An hour's watermark takes the place of the lookback that recounts late events; later ones are
dropped here, where the batch job would still store them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sigloom.operators import features, normalize
from sigloom.params import DEFAULT, Compat

WATERMARK = "60 minutes"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def normalized_stream(raw: DataFrame, compat: Compat = DEFAULT, watermark: str = WATERMARK) -> DataFrame:
    """Normalized events of a raw stream, one for each event_key that the watermark still covers."""
    rows = normalize.normalize(raw, compat) if "event_key" not in raw.columns else _keyed(raw, compat)
    rows = rows.withWatermark("event_time", watermark)
    return rows.dropDuplicatesWithinWatermark(["event_key"]).drop("event_key") if "event_key" in rows.columns else rows


def _keyed(raw: DataFrame, compat: Compat) -> DataFrame:
    kept = normalize._prepared(raw, compat).where(~F.col("__noise") & F.col("event_time").isNotNull())
    return kept.select(*normalize.COLUMNS, "event_key")


def feature_stream(events: DataFrame, bin_size_sec: int = 60, compat: Compat = DEFAULT) -> DataFrame:
    """The minute features of a watermarked stream; run it in update mode (append withholds open bins)."""
    return features.minute_rollup(events, bin_size_sec, features=[*features.minute_features(), *features.baseline_features()], compat=compat)


def keep_features(path: str, then: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is a folder of its own, so a repeated batch overwrites itself.

    :func:`latest_features` reads the newest count of each bin and key.  ``then`` gets the rows of the batch alone, which are the newest of
    their keys, so the work of a batch doesn't grow with those before it.
    """
    def put(batch: DataFrame, number: int) -> None:
        own = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        if then is not None:
            then(batch.sparkSession.read.schema(batch.schema).parquet(own))

    return put


def latest_features(stored: DataFrame) -> DataFrame:
    from sigloom.operators.state import latest_per_key

    return latest_per_key(stored, features.KEYS, "batch").drop("batch")
