"""A Python data source over a search server's export endpoint, batch and streaming.

The transport is a function named by the option ``transport`` ("package.module:function"):
called with a search and a half-open range of epoch seconds, it yields the response's lines.  Without that
option it is HTTP, to the option ``url``: see :mod:`sigloom.sources.http_search`.  Ranges are cut into
``splits``, or in a stream into ranges of about ``step`` seconds, read in parallel by the executors.
"""

from __future__ import annotations

import importlib
import json
import math
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from sigloom.sources import http_search

SESSION_SECONDS = 1800  # fixed value: how long a session key is used
RANGES = 256  # of a stream's trigger, at most


class SessionKey:
    """A login's key, asked for again after half an hour."""

    def __init__(self, login: Callable[[], str], clock: Callable[[], float] = time.monotonic):
        self.login, self.clock, self.key, self.until = login, clock, None, 0.0

    def __call__(self) -> str:
        if self.key is None or self.clock() >= self.until:
            self.key, self.until = self.login(), self.clock() + SESSION_SECONDS
        return self.key


def database_url(url: str) -> str:
    """A plain URL of one that names its driver."""
    scheme, sep, rest = url.partition("://")
    return scheme.split("+")[0] + sep + rest


def search_text(indexes: list[str] | None = None, minutes: int = 60, limit: int | None = None) -> str:
    """The export's search: indexes, time range, all fields, at most so many rows."""
    where = " OR ".join(f"index={x}" for x in indexes or ["*"])
    return f"search ({where}) earliest=-{minutes}m | fields *" + (f" | head {limit}" if limit else "")


class _Range(InputPartition):
    def __init__(self, start: float, end: float):
        self.start, self.end = start, end


def _lines(options: dict, start: float, end: float) -> Iterator[tuple]:
    search = options.get("search", search_text())
    if "transport" in options:
        module, _, name = options["transport"].partition(":")
        lines = getattr(importlib.import_module(module), name)(search, start, end)
    else:
        lines = http_search.export(search, start, end, options)
    strict = str(options.get("unwrap", "true")).lower() == "true"
    left, fields = int(options.get("limit", 0)) or None, _fields(options)
    for line in lines:
        line = line.decode("utf-8", "replace") if isinstance(line, bytes) else line
        if strict and not line.strip().startswith("{"):
            continue
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if strict:
            event = event.get("result")
            if event is None:
                continue
        yield _row(event if isinstance(event, dict) else {}, fields) if fields else (json.dumps(event, ensure_ascii=False),)
        if left is not None:
            left -= 1
            if not left:
                return


#: Columns beside ``event`` that the option ``fields`` may name, with the key of the event that each is.
TIME = "_time"


def _fields(options: dict) -> list[str]:
    return [x.strip() for x in options.get("fields", "").split(",") if x.strip()]


def _row(event: dict, fields: list[str]) -> tuple:
    """The event's text, and its fields as text or, of the time, as a timestamp."""
    def value(name: str):
        x = event.get(name)
        if name != TIME or x is None:
            return x if x is None or isinstance(x, str) else json.dumps(x)
        try:
            return datetime.fromtimestamp(float(x), timezone.utc)
        except ValueError:
            try:
                at = datetime.fromisoformat(str(x))
            except ValueError:
                return None
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)

    return (json.dumps(event, ensure_ascii=False), *map(value, fields))


def _quoted(x) -> str:
    return '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'


class _Reader(DataSourceReader):
    """A range cut into ``splits``, or one range if there is a ``limit``: a limit counts for the whole pull."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Range]:
        start, end = float(self.options.get("start", 0)), float(self.options["end"])
        n = 1 if int(self.options.get("limit", 0)) else int(self.options.get("splits", 1))
        cuts = [start + (end - start) * i / n for i in range(n + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)] if end > start else []

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _lines(self.options, partition.start, partition.end)


class _PushingReader(_Reader):
    """Predicates on time and on fields narrow the range and the search.

    Spark applies them again to what comes back, as a server may compare more loosely, so results are the same without.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        terms = []
        for f in filters:
            yield f
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == TIME and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.options["start"] = str(max(float(self.options.get("start", 0)), _seconds(f.value)))
            if name == TIME and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                # Ranges are half-open: an instant's own microsecond still counts.
                self.options["end"] = str(min(float(self.options["end"]), _seconds(f.value) + 1e-6))
            if name in _fields(self.options) and name != TIME:
                if isinstance(f, EqualTo):
                    terms.append(f"{name}={_quoted(f.value)}")
                elif isinstance(f, In):
                    terms.append("(" + " OR ".join(f"{name}={_quoted(x)}" for x in f.value) + ")")
                elif isinstance(f, StringStartsWith):
                    terms.append(f"{name}={_quoted(f.value + '*')}")
        if terms:
            search, bar, rest = self.options.get("search", search_text()).partition("|")
            self.options["search"] = f"{search.strip()} {' '.join(sorted(terms))}" + (f" | {rest.strip()}" if bar else "")


def _seconds(at: datetime) -> float:
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()


class _StreamReader(DataSourceStreamReader):
    """Offsets are epoch seconds.  A stream begins at ``start``, or now; a trigger reads up to ``lag`` seconds ago, for events that reach the
    server late, or to ``end`` if that is sooner, in ranges of ``step`` seconds: longer ones where there would be more than ``ranges``."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": float(self.options.get("start", time.time()))}

    def latestOffset(self) -> dict:
        return {"at": min(time.time() - float(self.options.get("lag", 0)), float(self.options.get("end", "inf")))}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        at, last = start["at"], end["at"]
        if last <= at:
            return []
        most = 1 if int(self.options.get("limit", 0)) else int(self.options.get("ranges", RANGES))
        n = min(most, max(1, math.ceil((last - at) / float(self.options.get("step", 60)))))
        return [_Range(at + (last - at) * i / n, at + (last - at) * (i + 1) / n) for i in range(n)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _lines(self.options, partition.start, partition.end)


class SearchExport(DataSource):
    """Format "search_export": rows (event string), and a column for each of the option ``fields``, ``_time`` being a timestamp.

    With the option ``pushdown`` (true) predicates reach the server; that needs spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls) -> str:
        return "search_export"

    def schema(self) -> str:
        return ", ".join(["event string", *(f"`{x}` {'timestamp' if x == TIME else 'string'}" for x in _fields(self.options))])

    def reader(self, schema) -> _Reader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (_PushingReader if pushing else _Reader)(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))
