"""Merkle manifest of a table: a digest of each row, of each group and of the whole, and a proof for every row.

The rows of a group, in order, are leaves; every eight nodes that follow one another become their digest until
one is left, the group's subroot.  The subroots, in the order of their groups, are the leaves of one more such tree.

1. Only digests move.  Leaves are sorted by range, as an RDD, so a large group lies in many partitions.  A partition
   tells how many rows its first and its last group have; their sums say where in its group each partition starts.
2. Every partition builds the subtrees that are whole in its range, ``CUT`` levels at most, and gives a row for
   each, with its leaves.  Those at the ragged ends of the range are small, down to single leaves.
3. Nodes go to the node ``CUT`` levels up, by its coordinate, which finishes the levels between: at most
   8 ** CUT nodes meet in one place, and three rounds do for 8 ** 12 rows.
4. Each node learns its siblings up to the root; leaves are proved within their subtree, and never sent singly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sigloom.llm.common import arrow_type, stored

FAN = 8
CUT = 4  # levels that are built in one place
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of the parts, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_of(*columns: Column) -> Column:
    """The digest of a row, as bytes: of each value as text with its length in bytes before it, or a hyphen for null."""
    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(told, columns)), 256))


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // FAN), h + 1
    return h


def subtrees(first: int, nodes: list[bytes], last: bool, levels: int, level: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of the largest whole subtrees over nodes that follow one another from index ``first``.

    ``last``: the group ends with them, so that a run of fewer than eight may be whole.
    """
    for at in range(level, level + levels):
        end = first + len(nodes)
        low, high = -(-first // FAN), -(-end // FAN) if last else end // FAN
        if low >= high or (last and first == 0 and len(nodes) == 1):
            break
        yield from ((at, i, nodes[i - first]) for i in (*range(first, low * FAN), *range(high * FAN, end)))
        nodes = [digest(nodes[p * FAN - first : (p + 1) * FAN - first]) for p in range(low, high)]
        first, level = low, at + 1
    yield from ((level, first + i, x) for i, x in enumerate(nodes))


def paths(leaves: list[bytes], levels: int) -> Iterator[list[bytes]]:
    """For each leaf of a whole subtree of so many levels the siblings before and after it, by level.

    A group's last subtree may have one node on several levels, each the digest of the one below.
    """
    rows = [leaves]
    for _ in range(levels):
        rows.append([digest(rows[-1][i : i + FAN]) for i in range(0, len(rows[-1]), FAN)])
    for at in range(len(leaves)):
        out = []
        for nodes in rows[:-1]:
            a = at - at % FAN
            out += [b"".join(nodes[a:at]), b"".join(nodes[at + 1 : a + FAN])]
            at //= FAN
        yield out


def folded(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        leaf = digest([before, leaf, after])
    return leaf


def _ends(part: int, rows: Iterator) -> Iterator[tuple]:
    """(partition, group, rows) of its first and of its last group."""
    found = [None, None]
    for k, own in groupby(rows, lambda r: r[0]):
        n = sum(1 for _ in own)
        found = [found[0] or (part, k, n), (part, k, n)]
    if found[0]:
        yield found[0]
        if found[0][1] != found[1][1]:
            yield found[1]


def _places(ends: list[tuple]) -> dict[tuple, tuple[int, bool]]:
    """For (partition, group) the group's rows before it, and whether the group ends in it."""
    before: dict[str, int] = {}
    last: dict[str, int] = {}
    out = {}
    for part, group, n in sorted(ends):
        out[part, group] = before.get(group, 0)
        before[group] = out[part, group] + n
        last[group] = part
    return {(p, g): (n, last[g] == p) for (p, g), n in out.items()}


def _built(places, cut: int):
    """Rows (g, digest, payload) of a partition to rows (g, level, idx, digest, leaves) of its subtrees."""
    block = FAN**cut

    def out(group: str, first: int, held: list, last: bool) -> Iterator[tuple]:
        for level, i, node in subtrees(first, [bytes(r[1]).hex().encode() for r in held], last, cut):
            a = i * FAN**level - first
            yield group, level, i, node.decode(), [(bytes(r[1]), r[2]) for r in held[a : a + FAN**level]]

    def run(part: int, rows: Iterator) -> Iterator[tuple]:
        for group, own in groupby(rows, lambda r: r[0]):
            at, ends = places.value.get((part, group), (0, True))
            held: list = []
            for r in own:
                # A block that is full may be the group's last; then nothing is left to close.
                if held and (at + len(held)) % block == 0:
                    yield from out(group, at, held, False)
                    at, held = at + len(held), []
                held.append(r)
            yield from out(group, at, held, ends)

    return run


@dataclass
class Tree:
    blocks: DataFrame  # (g, level, idx, digest, leaves): each leaf (leaf, payload) in one block
    above: DataFrame  # (g, level, idx, subroot, path): of each block, siblings up to its group's subroot
    subroots: DataFrame  # (g, n_leaves, subroot)


def tree(rows: DataFrame, order: list[str], cut: int = CUT, partitions: int | None = None) -> Tree:
    """The trees of ``rows`` (g, leaf, payload and the columns of ``order``), a tree for each g, its leaves in that order.

    ``rows`` is a stored table.  ``order`` has to tell unequal leaves apart.
    """
    spark = rows.sparkSession
    keys = ["g", *order]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    leaves = ranged.sortWithinPartitions(*keys).select("g", "leaf", "payload").rdd
    # Two numbers a partition; Spark's driver holds as much to cut the ranges.
    places = spark.sparkContext.broadcast(_places(leaves.mapPartitionsWithIndex(_ends).collect()))
    kind = T.ArrayType(T.StructType([T.StructField("leaf", T.BinaryType()), rows.schema["payload"]]))
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("leaves", kind)])
    blocks = stored(spark.createDataFrame(leaves.mapPartitionsWithIndex(_built(places, cut)), schema, verifySchema=False), "blocks")
    totals = stored(blocks.groupBy("g").agg(F.sum(F.size("leaves")).alias("n")), "totals")
    most = totals.agg(F.max("n")).first()[0] or 0
    nodes = blocks.select("g", "level", "idx", "digest").join(totals, "g")
    rounds = []
    for k in range(max(1, -(-height(most) // cut))):
        base = k * cut
        here = nodes.where(F.col("level") < base + cut) if base + cut < height(most) else nodes
        up = F.pow(F.lit(float(FAN)), F.lit(base + cut) - F.col("level")).cast("long")
        made = here.withColumn("place", F.floor(F.col("idx") / F.greatest(up, F.lit(1)))).groupBy("g", "place").applyInPandas(_climb(base, cut), "g string, n long, level int, idx long, path array<string>, up_level int, up_idx long, digest string")
        made = stored(made, "climbed")
        rounds.append(made)
        reached = made.select("g", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), "digest", "n").distinct()
        waiting = nodes.where(F.col("level") >= base + cut)
        nodes = reached.union(waiting) if base + cut < height(most) else reached
    tops = nodes.select("g", F.col("n").alias("n_leaves"), F.col("digest").alias("subroot"))
    above = nodes.select("g", "level", "idx", F.col("digest").alias("subroot"), F.array().cast("array<string>").alias("path"))
    for made in reversed(rounds):
        up = above.select("g", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), "subroot", F.col("path").alias("more"))
        own = made.join(up, ["g", "up_level", "up_idx"]).select("g", "level", "idx", "subroot", F.concat("path", "more").alias("path"))
        # A subroot, reached by itself with no sibling, stands for itself.
        above = own.union(above.join(made.select("g", "level", "idx"), ["g", "level", "idx"], "left_anti"))
    return Tree(blocks, stored(above, "above"), tops)


def _climb(base: int, cut: int):
    """The nodes below one node ``cut`` levels above ``base`` to their siblings up to it, or to the subroot."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        top = min(base + cut, height(n))
        known = {(level, i): x.encode() for level, i, x in zip(pdf["level"].tolist(), pdf["idx"].tolist(), pdf["digest"], strict=True)}
        wide = [n]
        while len(wide) <= top:
            wide.append(-(-wide[-1] // FAN))
        for level in range(base, top):
            for p in {i // FAN for at, i in known if at == level}:
                known[level + 1, p] = digest([known[level, i] for i in range(p * FAN, min((p + 1) * FAN, wide[level]))])
        out, up_idx, up_level = [], [], []
        for level, i in zip(pdf["level"].tolist(), pdf["idx"].tolist(), strict=True):
            path = []
            while level < top:
                a, b = i - i % FAN, min(i - i % FAN + FAN, wide[level])
                path += [b"".join(known[level, x] for x in range(a, i)).decode(), b"".join(known[level, x] for x in range(i + 1, b)).decode()]
                level, i = level + 1, i // FAN
            out.append(path)
            up_level.append(level)
            up_idx.append(i)
        nodes = [known[x].decode() for x in zip(up_level, up_idx, strict=True)]
        return pdf[["g", "n", "level", "idx"]].assign(path=out, up_level=up_level, up_idx=up_idx, digest=nodes)

    return run


def _keyed(docs: DataFrame, group: str, id_col: str, columns: tuple[str, ...], altered: dict[str, Column], where: Column | None) -> DataFrame:
    """(g, id, leaf, payload, row): g sorts as groups do, null first; row tells equal rows apart."""
    own = leaf_of(*[F.col(c) for c in columns])
    other = leaf_of(*[altered.get(c, F.col(c)) for c in columns])
    second = F.when(F.coalesce(where, F.lit(False)), other) if where is not None else F.lit(None).cast("binary")
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(g.alias("g"), F.col(id_col).alias("id"), own.alias("leaf"), F.struct(F.col(id_col).alias("id"), second.alias("altered")).alias("payload"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")


def _whole(docs: DataFrame, group: str, id_col: str, columns: tuple[str, ...], altered: dict[str, Column], where: Column | None, cut: int, partitions: int | None) -> tuple[Tree, DataFrame]:
    """The groups' trees, and (g, n_leaves, subroot, root, to_root) of each group."""
    trees = tree(_keyed(docs, group, id_col, columns, altered, where), ["id", "leaf", "row"], cut, partitions)
    subroots = stored(trees.subroots, "subroots")
    over = tree(stored(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.unhex("subroot").alias("leaf"), F.struct(F.col("g").alias("name")).alias("payload")), "tops"), ["name"], cut, partitions)
    schema = "name string, root string, to_root array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaves, path, root in _blocks(batches):
            got = [(x["payload"]["name"], root, [y.decode() for y in own] + path) for x, own in leaves]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], names=["name", "root", "to_root"])

    rooted = _with_paths(over).mapInArrow(run, schema).withColumnRenamed("name", "g")
    return trees, stored(subroots.join(rooted, "g"), "roots")


def _with_paths(t: Tree) -> DataFrame:
    return t.blocks.join(t.above, ["g", "level", "idx"]).select("leaves", "level", "path", "subroot")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each block its leaves with their siblings in it, and what else its row has."""
    for batch in batches:
        for at in range(batch.num_rows):
            leaves, level, *rest = (batch.column(i)[at].as_py() for i in range(batch.num_columns))
            yield zip(leaves, paths([x["leaf"].hex().encode() for x in leaves], level), strict=True), *rest


def manifest(docs: DataFrame, group: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, cut: int = CUT, partitions: int | None = None) -> DataFrame:
    """(group, n_leaves, subroot, root): a row for each group, null being one; an empty table has none."""
    _, roots = _whole(docs, group, id_col, columns, {}, None, cut, partitions)
    kind = docs.schema[group].dataType
    return roots.select(_named("g").cast(kind).alias(group), "n_leaves", "subroot", "root")


def _named(g: str) -> Column:
    return F.when(F.col(g) != "-", F.substring(F.col(g), 2, 2**31 - 1))


def proofs(docs: DataFrame, group: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, altered: dict[str, Column] | None = None, where: Column | None = None, with_path: bool = True, cut: int = CUT, partitions: int | None = None) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified and, ``with_path``, path.

    ``path`` lists, level by level, the siblings before and those after, as text; ``proof_sha256`` is the digest of
    all of them.  ``folded_root`` is what the row as read gives with its path: where ``where`` holds, the row as read has the
    values of ``altered`` instead of those that the manifest was made from.

    Leaves are in the order of the id, a null one first, then of the digest; rows that repeat others are leaves each.
    Null values are told from empty ones; null is a group of its own, before the others.  Columns are read by name and
    no other is; values other than text and whole numbers count as Spark's text of them.  A text is digested whole in
    one row, so a row has to fit a task.  An empty table gives an empty result.
    """
    trees, roots = _whole(docs, group, id_col, columns, altered or {}, where, cut, partitions)
    extra = [T.StructField("path", T.ArrayType(T.StringType()))] if with_path else []
    text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *text("leaf", "subroot", "root", "proof_sha256", "folded_root"), T.StructField("verified", T.BooleanType()), *extra])
    above = trees.above.join(roots.select("g", "root", "to_root"), "g").select("g", "level", "idx", F.concat("path", "to_root").alias("path"), "subroot", "root")
    rows = trees.blocks.join(above, ["g", "level", "idx"]).select("leaves", "level", "path", "subroot", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaves, path, subroot, root in _blocks(batches):
            above = [x.encode() for x in path]
            rest = b"".join(above)
            out = []
            for x, own in leaves:
                leaf, (key, other) = x["leaf"].hex(), (x["payload"]["id"], x["payload"]["altered"])
                found = folded((other.hex() if other else leaf).encode(), own + above).decode()
                proof = digest([*own, rest]).decode()
                out.append((key, leaf, subroot, root, proof, found, found == root, *([[y.decode() for y in own] + path] if with_path else [])))
                if len(out) == 4096:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow_type(schema[0].dataType), *[pa.string()] * 5, pa.bool_(), *[pa.list_(pa.string())] * len(extra)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def oracle_sql() -> str:
    """Leaves, trees and folds of ``documents`` for DuckDB; the checksum of the id by its bits."""
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(text if c == "text" else told(c) for c in COLUMNS) + ")"
    lower = told("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    around = lambda what, rest: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, level, idx // 8 ORDER BY idx ROWS BETWEEN {what}), '') AS {rest}"
    beside = around("UNBOUNDED PRECEDING AND 1 PRECEDING", "a") + ", " + around("1 FOLLOWING AND UNBOUNDED FOLLOWING", "b")
    climb = "SELECT g, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM {0} WHERE n > 1 GROUP BY g, level, idx // 8, n"
    return f"""WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
 d AS (SELECT *, row_number() OVER () AS rid, coalesce('=' || lang, '-') AS g,
   coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0, false) AS bad FROM documents, bits),
 l AS (SELECT rid, doc_id, g, {leaf(told("text"))} AS leaf, CASE WHEN bad THEN {leaf(lower)} END AS other FROM d),
 p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
 t(g, level, idx, h, n) AS (SELECT g, 0, idx, leaf, n FROM p UNION ALL {climb.format("t")}),
 s AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS idx, h, count(*) OVER () AS n FROM t WHERE n = 1),
 u(g, level, idx, h, n) AS (SELECT g, 0, idx, h, n FROM s UNION ALL {climb.format("u")}),
 x AS (SELECT g, level, idx, {beside} FROM t WHERE n > 1 UNION ALL SELECT g, level, idx, {beside} FROM u WHERE n > 1),
 f(rid, g, level, idx, h, proof) AS (SELECT rid, g, 0, idx, coalesce(other, leaf), '' FROM p
   UNION ALL SELECT f.rid, f.g, f.level + 1, f.idx // 8, sha256(a || h || b), proof || a || b FROM f JOIN x USING (g, level, idx)),
 top AS (SELECT arg_max(f.h, f.level) AS h, arg_max(proof, f.level) AS proof, f.rid, any_value(s.idx) AS idx, any_value(s.h) AS subroot FROM f JOIN s ON s.name = f.g GROUP BY f.rid),
 k(rid, level, idx, h, proof) AS (SELECT rid, 0, idx, h, proof FROM top
   UNION ALL SELECT rid, k.level + 1, k.idx // 8, sha256(a || h || b), proof || a || b FROM k JOIN x ON x.g = '' AND x.level = k.level AND x.idx = k.idx),
 e AS (SELECT rid, arg_max(h, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM k GROUP BY rid),
 r AS (SELECT h AS root FROM u WHERE n = 1)
 SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM e JOIN l USING (rid) JOIN top USING (rid), r"""
