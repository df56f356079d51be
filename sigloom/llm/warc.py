"""WARC archives: a writer of gzip members and a splittable reader.

Writer: each task streams its rows into archives of its own, a gzip member a record.  Names
are unique, and a stored manifest lists what successful tasks wrote; files of lost attempts
are never read.  Reader: archives are cut into byte ranges; a task looks for the gzip magic
inside its range, takes a candidate for a record only if it inflates to a WARC header, and
owns the records that start in its range, reading past the end where a record does.

A payload that gzip stores uncompressed can hold whole records, so a candidate alone proves nothing.  An index is made
first: each range finds the candidate from which member follows member to the range's end, and says
where the first record beyond the end starts.  The file's start is a record; where a range's first
record is not where the range before says it is, the range is indexed again from there.  Then
the records are read from the starts in the index.
Archives are reached through ``pyarrow.fs``, so any store it knows will do.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sigloom.llm.common import stored, work_path

LEAST_BYTES = 100  # smaller payloads are never revisits
ARCHIVE_BYTES = 256 << 20  # a task starts another archive beyond this
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record_id(page: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>"


def encode(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has the HTTP header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page, url), "WARC-Date": "2024-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head["WARC-Payload-Digest"] = "sha256:" + hashlib.sha256(payload).hexdigest()
    if page is not None:
        head["X-Page-Id"] = page
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "X-Refers-To-Page-Id": refers_to}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return "".join(["WARC/1.0\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def decode(record: bytes) -> dict:
    """Header fields, lower-cased, with ``payload`` (None for a revisit) and ``payload_bytes``."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    own = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    revisit = fields["warc-type"] == "revisit"
    return fields | {"payload": None if revisit else payload, "payload_bytes": int(own[1]) if revisit and own else len(payload)}


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload binary, refers_to) below ``folder``; the manifest (path, bytes, records)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        done, out, name, size, count = [], None, "", 0, 0
        for batch in batches:
            for at in range(batch.num_rows):
                page, url, payload, refers = (c[at].as_py() for c in batch.columns)
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                        done.append((name, size, count))
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip_member(encode(page, url, payload or b"", refers))
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{x[0]}" for x in done], "bytes": pa.array([x[1] for x in done], pa.int64()), "records": pa.array([x[2] for x in done], pa.int64())})

    return stored(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """A file read forwards, with a buffer that grows on demand and can drop what lies behind."""

    def __init__(self, f, at: int):
        self.f, self.base, self.buf, self.ended = f, at, b"", False
        f.seek(at)

    def more(self, n: int = 1 << 20) -> bool:
        got = b"" if self.ended else self.f.read(n)
        self.ended = not got
        self.buf += got
        return bool(got)

    def drop(self, at: int) -> None:
        self.buf, self.base = self.buf[at - self.base :], at


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The WARC record whose gzip member starts at ``at`` and the offset behind it, if there is one.

    A candidate that doesn't inflate to a WARC header is none; a record that breaks off is an error.
    """
    z, head, parts, i = zlib.decompressobj(31), b"", [], at - w.base
    while not z.eof:
        if i >= len(w.buf) and not w.more():
            if head[:7] == b"WARC/1.":
                raise ValueError(f"a record breaks off at {at}")
            return None
        data = w.buf[i : i + (1 << 20 if len(head) >= 7 else 4096)]  # a candidate is judged by its first kilobytes
        i += len(data)
        try:
            parts.append(z.decompress(data))
        except zlib.error as e:
            if head[:7] == b"WARC/1.":
                raise ValueError(f"a record is damaged at {at}") from e
            return None
        if len(head) < 7:
            head += parts[-1]
            if len(head) >= 7 and head[:7] != b"WARC/1.":
                return None
    return (b"".join(parts), w.base + i - len(z.unused_data)) if head[:7] == b"WARC/1." else None


def _next_candidate(w: _Window, at: int, end: int) -> int | None:
    """The first gzip magic in [at, end); the window is dropped up to it."""
    while at < end:
        hit = w.buf.find(MAGIC, at - w.base)
        if hit >= 0:
            at = w.base + hit
            w.drop(at)
            return at if at < end else None
        at = max(at, w.base + len(w.buf) - len(MAGIC) + 1)
        w.drop(at)
        if not w.more():
            return None
    return None


def _chain(w: _Window, at: int, end: int, size: int) -> Iterator[tuple[bytes, int]]:
    """The records (record, offset behind it) from a true start ``at`` on that start before ``end``."""
    while at < min(end, size):
        w.drop(at)
        if (found := _member(w, at)) is None:
            raise ValueError(f"no record at {at}")
        record, at = found
        yield record, at


def index_range(store: pafs.FileSystem, path: str, start: int, end: int, known: int | None = None) -> tuple[int | None, int | None]:
    """(first, behind): where the first record of [start, end) starts, and the first record at or behind ``end``.

    Both are None if no record starts in the range.  Without ``known`` the first is the first candidate from which
    members follow each other to the end of the range or of the file; a candidate within a payload breaks
    off sooner, unless the records that the payload holds reach to the end.
    """
    with store.open_input_file(path) as f:
        size = f.size()
        at = start if known is None else known
        while at < end:
            w = _Window(f, at)
            if known is None and (at := _next_candidate(w, at, end)) is None:
                return None, None
            try:
                first = at
                for _, at in _chain(w, first, end, size):
                    pass
                return first, at
            except ValueError:
                if known is not None:
                    raise
                at = first + 1
    return None, None


def read_range(store: pafs.FileSystem, path: str, first: int, end: int) -> Iterator[bytes]:
    """The records from that at ``first`` on that start before ``end``."""
    with store.open_input_file(path) as f:
        for record, _ in _chain(_Window(f, first), first, end, f.size()):
            yield record


def _dealt(parts: DataFrame, *keys: str) -> DataFrame:
    # The rows are few and small but each is much work: a fixed number of partitions isn't merged.
    n, width = parts.count(), parts.sparkSession.sparkContext.defaultParallelism
    return parts.repartition(max(1, min(n, max(4 * width, n // 64))), F.xxhash64(*keys))


def range_index(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, first, behind) of every range in which a record starts, a stored table.

    Every range follows from the one before, so an index in which all agree is the one that a reader from the file's start makes.
    """
    schema = "path string, start long, first long, behind long"

    def indexed(asked: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for path, start, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    store, name = _open(path)
                    rows.append((path, start, *index_range(store, name, start, start + range_bytes, known)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, kinds, strict=True)], names=["path", "start", "first", "behind"])

        return stored(_dealt(asked, "path", "start").mapInArrow(run, schema), "warc-index")

    parts = manifest.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    now = indexed(parts.withColumn("known", F.when(F.col("start") == 0, F.lit(0).cast("long"))))
    order = Window.partitionBy("path").orderBy("start")  # a row a range of one file
    while True:
        # Where the ranges before say that the next record starts.
        said = now.withColumn("said", F.coalesce(F.last("behind", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        in_range = F.col("said") < F.col("start") + range_bytes
        wrong = F.when(in_range, ~F.col("first").eqNullSafe(F.col("said"))).otherwise(F.col("first").isNotNull())
        # Only the first wrong range of a file is known to be; those behind it are judged again afterwards.
        bad = said.where(wrong).groupBy("path").agg(F.min(F.struct("start", "said")).alias("x")).select("path", "x.*")
        bad = stored(bad, "warc-wrong")
        if bad.isEmpty():
            return now.where("first IS NOT NULL")
        none = bad.where(F.col("said") >= F.col("start") + range_bytes).select("path", "start", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("behind"))
        again = indexed(bad.where(F.col("said") < F.col("start") + range_bytes).select("path", "start", F.col("said").alias("known")))
        now = stored(now.join(bad, ["path", "start"], "left_anti").union(none).union(again), "warc-index")


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the archives in ``manifest`` (path, bytes), each read by the range it starts in.

    Size and digest of a response are those of the payload that was read, and a header that says otherwise is an error; a
    revisit has those of its header.
    """
    spread = _dealt(range_index(manifest, range_bytes).select("path", "start", "first"), "path", "start")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

        for batch in batches:
            for path, start, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _open(path)
                rows, size = [], 0
                for record in read_range(store, name, first, start + range_bytes):
                    x = decode(record)
                    page, refers, said = x.get("x-page-id"), x.get("x-refers-to-page-id"), x["warc-payload-digest"].removeprefix("sha256:")
                    if x["payload"] is not None and hashlib.sha256(x["payload"]).hexdigest() != said:
                        raise ValueError(f"a payload of {path} differs from its digest {said}")
                    rows.append((None if page is None else int(page), x.get("warc-target-uri"), x["warc-type"], x["payload_bytes"], said, None if refers is None else int(refers), x["payload"]))
                    size += len(record)
                    if size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spread.mapInArrow(run, schema)


def archive_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): what the writer takes from ``pages`` (page_id, url, html).

    Of equal payloads of ``LEAST_BYTES`` or more, the smallest page_id is the response.  Roles are found from ids and
    digests; payloads are shuffled once, by id and digest, so a payload of very many pages is spread.
    Rows that repeat page_id and html share its role; a null page_id comes after all others; null html is an empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= LEAST_BYTES, F.sha2("payload", 256)))
    narrow = rows.select("page_id", "digest").where("digest IS NOT NULL")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    later = narrow.distinct().join(first, "digest").where("NOT page_id <=> first").select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first")
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.coalesce("digest", F.lit("-")) == F.col("d")), "left")
    return joined.select("page_id", "url", "payload", F.col("first").alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back; no rows, no archives, an empty result."""
    return read_archives(write_archives(archive_roles(pages), work_path(spark, "warc")), range_bytes)
