"""SimHash fingerprints, linked by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints differ in at
most two bits, then either the high segments differ in at most one bit, or the low
segments are equal.  So a fingerprint looks up the Hamming ball of radius one around its
high segment and the ball of radius zero around its low segment; every match is verified
on all 64 bits.  Flips are enumerated from 0 to 1 only: of two segments one bit apart,
exactly one has the zero.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sigloom.llm.common import map_rows, stored
from sigloom.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Word shingles, repeats included; fewer words than ``width`` make one shingle, none make none."""
    words = (text or b"").translate(_LOWER).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1]
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    grams = shingles(text, width)
    if not grams:
        return 0
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(grams), 65536):
        part = grams[at : at + 65536]
        h = np.fromiter((digest(x, 42) for x in part), np.uint64, len(part)).astype(">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row for each row of ``docs``; a null text counts as empty."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))

    def make():
        return lambda texts: {"fp": [fingerprint(x, width) for x in texts]}

    return map_rows(src, make, [T.StructField("fp", T.LongType())], [id_col], "__text")


def _high(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def _flipped_up(x: Column) -> Column:
    """The segment with one of its zeros set, for each of them."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return F.filter(ones, lambda y: y != x)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most ``radius`` (0 to 3) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one cover at most three bits")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = [_high(F.col("fp")), low]
    table = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), x.alias("key")) for i, x in enumerate(segments)])).alias("x")).select("fp", "x.seg", "x.key")
    probe = table.withColumn("flipped", F.lit(False))
    # Up to one bit: no ball is needed, a segment is equal.  Two: a ball around the high one.  Three: around both.
    for i, x in enumerate(segments[: max(0, radius - 1)]):
        probe = probe.unionByName(distinct.select("fp", F.lit(i).alias("seg"), F.explode(_flipped_up(x)).alias("key"), F.lit(True).alias("flipped")))
    hits = probe.withColumnRenamed("fp", "a").join(table.withColumnRenamed("fp", "b"), ["seg", "key"])
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return hits.where(close & (F.col("a") != F.col("b")) & (F.col("flipped") | (F.col("a") < F.col("b")))).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): every row with the smallest id reachable over links of fingerprints.

    Null and empty texts have fingerprint zero and link like any other.  Rows that repeat an
    id each get the component of their own text.  A null id links like any other but never names a
    component; one of null ids only has a null component.  An empty table gives an empty result.
    Copies are folded to one fingerprint before anything is joined, so a group of any size
    is one node.
    """
    prints = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    group = components(links(nodes.select("fp"), radius).select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = nodes.join(group, nodes.fp == group.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = known.groupBy("group").agg(F.min("least").alias("component_id"))
    found = known.join(named, "group").select("fp", "component_id")
    return prints.join(found, "fp").select(id_col, "fp", "component_id")


def hex_print(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
