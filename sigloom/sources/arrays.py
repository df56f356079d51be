"""Events of large files that are one JSON array, or {"results": [...]}, in ranges.

Spark's text source cuts a file at commas, wherever ranges begin, so a range is a run of pieces.  Whether it begins inside a string, and how
deep in brackets, isn't known to it: it is read once to tell how quotes and brackets change either way, the ranges of a file are put
in order, and it is read again to tell which commas part elements.  Elements inside a range are whole; the text before a
range's first comma and after its last is joined with that of its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sigloom.storage import stored

_MARK = re.compile(r'\\.|["\[\]{}]', re.S)
_HEAD = re.compile(r'^\ufeff?\s*(?:(\[)|\{\s*"results"\s*:\s*\[)')


class Walk:
    """Quotes and brackets up to here, from a start outside of strings (0) or inside one (1)."""

    def __init__(self, odd: bool = False, depth: int = 0):
        self.odd, self.depth = odd, [depth, depth]

    def over(self, piece: str) -> Iterator[tuple[int, str]]:
        """Step through a piece; yields the place of each bracket after counting it."""
        for m in _MARK.finditer(piece):
            x = m.group()
            if x == '"':
                self.odd = not self.odd
            elif len(x) == 1:
                self.depth[self.odd] += 1 if x in "[{" else -1
                yield m.start(), x


def _ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(path, start, pieces) of each range; pieces come in order."""
    each = (r for b in rows for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (path, start), own in groupby(each, lambda r: r[:2]):
        yield path, start, (r[2] for r in own)


def _summaries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, start, pieces in _ranges(rows):
        walk, seen, head = Walk(), (set(), set()), None
        for piece in pieces:
            head = piece[:1000] if head is None else head
            for _ in walk.over(piece):
                pass
            # The comma after the piece lies in no string if the start was outside and quotes are even, or the other way.
            seen[walk.odd].add(walk.depth[walk.odd])
        yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "odd": walk.odd, "d0": walk.depth[0], "d1": walk.depth[1], "s0": sorted(seen[0]), "s1": sorted(seen[1]), "head": head or ""}], schema=_SUMMARY)


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("d0", pa.int32()), ("d1", pa.int32()), ("s0", pa.list_(pa.int32())), ("s1", pa.list_(pa.int32())), ("head", pa.string())])


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """How each range of a file begins: in a string or not, how deep, and in which range the element began that goes on in it."""
    out, inside, depth, owner, level = [], False, 0, 0, 0
    for r in pdf.sort_values("start").itertuples():
        if not out:
            m = _HEAD.match(r.head)
            level = 0 if m is None else 1 if m.group(1) else 2
            owner = r.start
        out.append((r.path, r.start, inside, depth, level, owner))
        seen = r.s1 if inside else r.s0
        if level - depth in set(seen):
            owner = r.start
        depth += int(r.d1 if inside else r.d0)
        inside ^= r.odd
    return pd.DataFrame(out, columns=["path", "start", "inside", "depth", "level", "owner"])


def _elements(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, owner, start, text): whole elements without owner, and pieces of those that cross ranges."""
    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else ((),) * 4, kinds, strict=True)], names=["path", "owner", "start", "text"])

    each = (r for b in rows for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (path, start, inside, depth, level, owner), own in groupby(each, lambda r: r[:6]):
        if not level:
            continue
        # ``walk`` starts outside of strings or inside; its depth counts where quotes say so.
        walk, held, found, first, ended, size = Walk(inside, depth), [], [], start > 0, False, 0
        for k, r in enumerate(own):
            piece = r[6]
            if ended:
                continue
            cut = _HEAD.match(piece).end() if start == 0 and k == 0 else 0
            last = None
            for at, x in walk.over(piece):
                if x in "]}" and walk.depth[0] < level and at >= cut:
                    last, ended = at, True
                    break
            held.append(piece[cut:last])
            if ended or (not walk.odd and walk.depth[0] == level):
                text = ",".join(held)
                # Its end closes the array's last element, which the loop's rest would do for a range's.
                found.append((path, owner if first else None, start, text))
                held, first, size = [], False, size + len(text)
                if size >= 4 << 20:
                    yield batch(found)
                    found, size = [], 0
        if held:
            found.append((path, owner if first else start, start, ",".join(held)))
        yield batch(found)


def array_events(spark: SparkSession, path: str) -> DataFrame:
    """(path, event): the objects of such files, as JSON text.  Elements that don't parse or aren't objects are left out, as
    are files of other shapes: see :func:`sigloom.sources.files.read_files` for those, which reads a file whole.

    A range is as long as Spark's input partitions; an element has to fit in memory, a file doesn't.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    summary = "path string, start long, odd boolean, d0 int, d1 int, s0 array<int>, s1 array<int>, head string"
    state = "path string, start long, inside boolean, depth int, level int, owner long"
    # A row a range: a file of a terabyte has some thousands.
    states = stored(pieces.mapInArrow(_summaries, summary).groupBy("path").applyInPandas(_states, state), "ranges")
    known = pieces.join(F.broadcast(states), ["path", "start"]).select("path", "start", "inside", "depth", "level", "owner", "value")
    found = stored(known.mapInArrow(_elements, "path string, owner long, start long, text string"), "elements")
    crossing = found.where("owner IS NOT NULL").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("x"))
    joined = crossing.select("path", F.array_join(F.transform("x", lambda y: y["text"]), ",").alias("text"))
    v = F.try_parse_json("text")
    rows = found.where("owner IS NULL").select("path", "text").union(joined).select("path", v.alias("v"))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT")).select("path", F.to_json("v").alias("event"))
