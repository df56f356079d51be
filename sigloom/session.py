"""Session settings, and the package on a local session's Python path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that the results rely on (the time zone) or that every job here profits from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
#: Those that change what a payload's JSON says: of a repeated key the last value counts.
PARSING = ["spark.sql.variant.allowDuplicateKeys"]
_shipped: set[str] = set()


def build_session(name: str = "sigloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}})
    return (builder.master(master) if master else builder).getOrCreate()


def settle(spark: SparkSession) -> None:
    """Set what parsing relies on in a session that was built elsewhere; it holds for frames that are planned afterwards."""
    for k in PARSING:
        if spark.conf.get(k) != SETTINGS[k]:
            spark.conf.set(k, SETTINGS[k])


def spread(rows: DataFrame) -> DataFrame:
    """A scan of one file, or of few, dealt out to all cores: where three in four cores would wait, rows are worth a shuffle.

    A table with more partitions than a quarter of the cores is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 4 * rows.rdd.getNumPartitions() <= cores else rows


def ship(spark: SparkSession) -> None:
    """Let a local session's Python workers find this package wherever they start.

    On a cluster the package comes with ``--py-files``; nothing is sent from a local folder there.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped or not spark.sparkContext.master.startswith("local["):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="sigloom-ship-")) / "sigloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
