"""What the corpus operators share: the work folder and Arrow mapping helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.storage import shared_dir, stored, work_path

__all__ = ["arrow_type", "map_rows", "remainder", "shared_dir", "stored", "work_path"]


ARROW = {T.StringType: pa.string, T.LongType: pa.int64, T.IntegerType: pa.int32, T.DoubleType: pa.float64, T.BooleanType: pa.bool_, T.BinaryType: pa.binary}


def arrow_type(t: T.DataType) -> pa.DataType:
    return pa.list_(arrow_type(t.elementType)) if isinstance(t, T.ArrayType) else ARROW[type(t)]()


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the held-out split of the classifiers."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], dict]], fields: list[T.StructField], keep: list[str], value: str, rows: int = 512) -> DataFrame:
    """Append columns computed from column ``value``; ``keep`` columns pass through untouched.

    ``make()`` runs once in each task and returns a function from a list of values to a
    dict of column lists.  Arrow batches are cut to ``rows`` rows, so memory follows the
    longest texts of one slice, not the partition.
    """
    src = df.select(*keep) if value in keep else df.select(*keep, F.col(value).alias("__value"))
    place = keep.index(value) if value in keep else len(keep)
    schema = T.StructType([*(src.schema[c] for c in keep), *fields])
    added = [(x.name, arrow_type(x.dataType)) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = f(part.column(place).to_pylist())
                cols = [*part.columns[: len(keep)], *(pa.array(got[n], type=t) for n, t in added)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(n for n, _ in added)])

    return src.mapInArrow(run, schema)
