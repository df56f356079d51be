"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised.  Exponent 1 keeps the
shares, 0 makes all weights equal.  The exponent is bisected to the smallest that keeps every
source within a repetition limit at the token budget, or to the one whose weights have a
target entropy.  Weights are realised as block permutations: each epoch of a source shuffles
its blocks of documents and the documents in each, by hashes; documents are taken in that
order until the source's tokens are used up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigloom.llm.common import stored

BLOCK_TOKENS = 200_000
REPETITIONS = 2.0
BLOCK_DOCUMENTS = 50_000
PARTS = 32  # of an interval, tried at once


def weights_at(shares: dict[str, float], exponent: float) -> dict[str, float]:
    top = max(shares.values())
    raised = {k: (v / top) ** exponent for k, v in shares.items()}
    total = math.fsum(raised.values())
    return {k: v / total for k, v in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def bisected(too_flat: Callable[[list[float]], list[bool]]) -> float:
    """The least exponent in [0, 1] that isn't too flat: the interval is cut in 32 parts, twelve times."""
    low, high = 0.0, 1.0
    if not too_flat([low])[0]:
        return low
    for _ in range(12):
        edges = [low, *(low + (high - low) * i / PARTS for i in range(1, PARTS)), high]
        told = too_flat(edges[1:-1])
        k = told.index(False) if False in told else PARTS - 1
        low, high = edges[k], edges[k + 1]
    return high


def fit(sums: Callable[[list[float]], list[tuple[float, float]]], least: float, top: float, repetitions: float | None, target_entropy: float | None, budget: float | None) -> float:
    """The exponent by bisection; without a budget the covering one of each exponent holds.

    With r the tokens of a source by those of the largest, ``top``, ``sums`` gives for each exponent x the sums of r^x and of
    r^x ln r, and ``least`` is the least r.  Nothing else is asked of the sources, so they may be any number: a source's
    weight is r^x by the sum, all are taken whole once at ``top`` times the sum, and the smallest repeats most.
    """
    def too_flat(xs: list[float]) -> list[bool]:
        if target_entropy is not None:
            return [math.log(z) - x * zl / z > target_entropy for x, (z, zl) in zip(xs, sums(xs), strict=True)]
        if budget is None:
            return [least ** (x - 1) > repetitions * (1 + 1e-12) for x in xs]
        return [budget / (z * top) * least ** (x - 1) > repetitions * (1 + 1e-12) for x, (z, _) in zip(xs, sums(xs), strict=True)]

    return bisected(too_flat)


def fit_exponent(tokens: dict[str, float], repetitions: float | None = REPETITIONS, target_entropy: float | None = None, budget: float | None = None) -> float:
    """:func:`fit` for sources at hand."""
    top = max(tokens.values())
    r = [v / top for v in tokens.values()]
    return fit(lambda xs: [(math.fsum(v**x for v in r), math.fsum(v**x * math.log(v) for v in r)) for x in xs], min(r), top, repetitions, target_entropy, budget)


def token_count(text: Column) -> Column:
    """Words: runs of characters other than whitespace."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _salt(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def mix(docs: DataFrame, repetitions: float = REPETITIONS, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, with_salt: bool = False) -> DataFrame:
    """(id, source, tokens, weight, epoch, block, position): one row for each time a document is taken.

    ``position`` is the hash order inside the epoch's block, ``block`` the hash order of the block;
    sorting by (epoch, block, position, id) gives a source's stream.  A null source is a source
    of its own.  Documents without a word are taken along at no cost in the first epoch.  A document
    that crosses the end of its source's budget is taken; none behind it is.  Rows that repeat an id
    are documents of their own, in any order among themselves.  An empty table gives an empty result.
    """
    rows = stored(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), token_count(F.col(text_col)).alias("__tokens"), _salt(id_col, text_col).alias("__salt")), "tokens")
    sources = stored(rows.groupBy("__source").agg(F.sum("__tokens").cast("double").alias("__size"), F.count("*").alias("__docs")), "sources")
    with_words = sources.where("__size > 0")
    span = with_words.agg(F.min("__size"), F.max("__size")).first()
    top = span[1] or 1.0

    def sums(xs: list[float]) -> list[tuple[float, float]]:
        r = F.col("__size") / F.lit(top)
        row = with_words.agg(*(y for x in xs for y in (F.sum(F.pow(r, F.lit(x))), F.sum(F.pow(r, F.lit(x)) * F.log(r))))).first()
        return list(zip(row[::2], row[1::2], strict=True))

    exponent = fit(sums, span[0] / top, top, repetitions, target_entropy, budget) if span[0] else 1.0
    total = sums([exponent])[0][0] if span[0] else 1.0
    whole = total * top if budget is None else float(budget)
    weight = F.when(F.col("__size") > 0, F.pow(F.col("__size") / F.lit(top), F.lit(exponent)) / F.lit(total)).otherwise(F.lit(0.0))
    quota = F.col("weight") * F.lit(whole)
    if budget is None:  # the source that sets the covering budget: exactly once
        quota = F.when(F.abs(quota - F.col("__size")) < 1e-6 * F.greatest(F.lit(1.0), "__size"), F.col("__size")).otherwise(quota)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("__size") / block_tokens), F.ceil(F.col("__docs") / BLOCK_DOCUMENTS)).cast("long")
    epochs = F.when(F.col("__size") > 0, F.greatest(F.lit(1), F.ceil(F.col("__quota") / F.col("__size") - 1e-9))).otherwise(F.lit(1)).cast("int")
    spec = sources.select(F.col("__source").alias("__s"), weight.alias("weight"), "__size", blocks.alias("__blocks")).withColumn("__quota", quota).withColumn("__epochs", epochs)
    joined = rows.join(spec, F.col("__source").eqNullSafe(F.col("__s")))  # broadcast or shuffled by the size of the stored table
    group = F.pmod(F.xxhash64(F.lit(seed), "__id", "__salt"), "__blocks")
    taken = joined.withColumn("group", group).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
    block = F.xxhash64(F.lit(seed), "epoch", "group")
    taken = taken.withColumn("block", block).withColumn("position", F.xxhash64(F.lit(seed + 1), "epoch", "__id", "__salt"))
    # How far each block reaches: a row for each source, epoch and block, summed in ranges of hashes and then within them.
    reach = taken.groupBy("__source", "epoch", "block", "group", "__quota", "__size").agg(F.sum("__tokens").alias("n")).withColumn("range", F.shiftright("block", 54))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = reach.groupBy(F.col("__source").alias("__s3"), F.col("epoch").alias("__e3"), F.col("range").alias("__r3")).agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("__ranges", earlier(Window.partitionBy("__s3", "__e3").orderBy("__r3"))).drop("n")  # 1024 rows at most
    within = earlier(Window.partitionBy("__source", "epoch", "range").orderBy("block", "group"))
    reach = reach.withColumn("before", within).join(ranges, F.col("__source").eqNullSafe(F.col("__s3")) & (F.col("epoch") == F.col("__e3")) & (F.col("range") == F.col("__r3")))
    reach = reach.withColumn("before", F.col("epoch") * F.col("__size") + F.col("__ranges") + F.col("before"))
    state = F.when(F.col("before") + F.col("n") <= F.col("__quota"), "all").when(F.col("before") >= F.col("__quota"), "none").otherwise("cut")
    reach = reach.withColumn("state", state).select(F.col("__source").alias("__s2"), F.col("epoch").alias("__e2"), F.col("group").alias("__g2"), "before", "state")
    at = F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("epoch") == F.col("__e2")) & (F.col("group") == F.col("__g2"))
    both = taken.join(reach, at).withColumn("state", F.when((F.col("epoch") == 0) & (F.col("__size") == 0), F.lit("all")).otherwise(F.col("state")))
    both = both.drop("__s2", "__e2", "__g2")
    cut = both.where("state = 'cut'")
    ahead = F.coalesce(F.sum("__tokens").over(Window.partitionBy("__source", "epoch", "group").orderBy("position", "__id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("__ahead", F.col("before") + ahead).where("__ahead < __quota").drop("__ahead")
    kept = both.where("state = 'all'").unionByName(cut)
    return kept.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__tokens").alias("tokens"), "weight", "epoch", "block", "position", *(["__salt"] if with_salt else []))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` and epoch, block, position, weight: a row for each time a document is taken.

    Columns of ``docs`` with one of these four names are replaced.  Nulls, empty texts and tables and repeated rows
    are as in :func:`mix`; rows that repeat id and text are all taken where one of them is.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, with_salt=True, **options)
    # Rows that repeat id and text have the same place in the plan.
    plan = plan.groupBy(F.col(id_col).alias("__id"), F.col("__salt").alias("__s"), "epoch").agg(F.min("block").alias("block"), F.min("position").alias("position"), F.min("weight").alias("weight"))
    columns = [c for c in docs.columns if c not in ("epoch", "block", "position", "weight")]
    salted = docs.select(*columns).withColumn("__salt", _salt(id_col, text_col))
    return salted.join(plan, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__salt") == F.col("__s"))).select(*columns, "epoch", "block", "position", "weight")
