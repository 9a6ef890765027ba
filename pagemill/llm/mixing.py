"""Mixing sources to target weights: temperature mixing.

Source shares of the tokens are raised to an exponent and normalised; the exponent is found by bisection, so
that the weights reach a target entropy, or that no source is repeated more often than a limit. The weights of
a token budget are then realised: a source is gone through as often as its budget holds, and the last, partial pass
takes blocks of its documents in a permuted order until the budget is met.

Scale: one pass over the texts counts tokens (ids, sources and counts are then staged for the sums, which are all
pre-aggregated), and one marks the documents. A
document's block and its place come from hashes of its id, so the last pass is narrow: it is joined with
one row for each source, broadcast only up to BROADCAST_SOURCES of them, and nothing sorts or gathers a source's documents, however large the source is.
The block in which a budget ends is found on two levels: among at most 65,536 groups of blocks, then within one group.
The driver holds a row for each distinct total of a source, as equal totals have equal weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import Scratch

#: Tokens of a block, about. Only the block in which a source's budget ends is looked at document by document.
BLOCK_TOKENS = 1 << 16
#: Up to so many sources their rows (some 200 bytes each) are broadcast; more are joined by shuffles.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Tokens where none are given: runs of anything but ASCII white space; null: none."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))
    return F.when(clean == "", F.lit(0)).otherwise(F.length(clean) - F.length(F.translate(clean, " ", "")) + 1).cast("long")


def weights_at(shares: list[float], exponent: float, times: list[int] | None = None) -> list[float]:
    """The weight of a source of each share; times: how many sources have it."""
    raised = [p**exponent if p > 0 else 0.0 for p in shares]
    total = math.fsum(raised if times is None else (x * k for x, k in zip(raised, times, strict=True)))
    return [x / total for x in raised] if total else raised


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def temperature(tokens: list[int], budget: int, *, target_entropy: float | None = None, max_repeats: float | None = None, times: list[int] | None = None) -> float:
    """The exponent in [0, 1]: 1 keeps the shares, 0 makes sources equal.

    The largest whose weights reach target_entropy (0 if none does, as equal weights are as far as mixing goes), but large
    enough that no source is repeated beyond max_repeats; 1 if even that repeats more. Bisection, as entropy falls
    and repetition falls with the exponent. times: how many sources have each number of tokens, 1 if None.
    """
    times = [1] * len(tokens) if times is None else times
    total = sum(t * k for t, k in zip(tokens, times, strict=True))
    if not total:
        return 1.0
    shares = [t / total for t in tokens]

    def spread(exponent: float) -> float:
        weights = weights_at(shares, exponent, times)
        return -math.fsum(k * w * math.log(w) for w, k in zip(weights, times, strict=True) if w > 0)

    def least(holds) -> float:  # noqa: ANN001
        """The least exponent from which on `holds` is true."""
        low, high = 0.0, 1.0
        if holds(low):
            return low
        if not holds(high):
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if holds(mid) else (mid, high)
        return high

    exponent = 1.0 if target_entropy is not None or max_repeats is None else 0.0
    if target_entropy is not None:
        exponent = least(lambda a: spread(a) <= target_entropy)
    if max_repeats is not None:
        exponent = max(exponent, least(lambda a: all(w * budget <= max_repeats * t for w, t in zip(weights_at(shares, a, times), tokens, strict=True))))
    return exponent


def _hashed(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def mixture(documents: DataFrame, *, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = 4.0, tokens: Column | None = None, seed: int = 0) -> DataFrame:
    """`documents` (doc_id, text, source) with n_tokens, block and copies: how often the mixture holds each row.

    budget: tokens of the mixture, those of the input if None. target_entropy is in nats; a value of 0 to 1 may be given as
    a share of the log of the number of sources by multiplying it yourself. A source's total is its weight of the budget, less what its
    next document would exceed it by. Rows of equal doc_id and source stand or fall together. Null sources are one
    source, null and empty texts have no tokens, and a source without tokens gets no copies. Columns
    named n_tokens, block or copies are replaced.
    """
    spark = documents.sparkSession
    source, doc_id = F.col("source").cast("string"), F.col("doc_id").cast("string")
    counted = word_count(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("mix_row"), "doc_id", "source", counted.alias("n_tokens"))
    scratch = Scratch(spark, "mixing")
    light = scratch.put(documents.select("doc_id", "source", counted.alias("n_tokens")), "counts")
    totals = scratch.put(light.groupBy(source.alias("mix_source")).agg(F.sum("n_tokens").alias("n")), "totals")
    held = sorted((r["n"], r["count"]) for r in totals.groupBy("n").count().collect())
    counts, times = [n for n, _ in held], [k for _, k in held]
    total, sources = sum(n * k for n, k in held), sum(times)
    budget = total if budget is None else budget
    exponent = temperature(counts, budget, target_entropy=target_entropy, max_repeats=max_repeats, times=times)
    weights = weights_at([n / total for n in counts], exponent, times) if total else [0.0] * len(counts)
    plan = []
    for n, w in zip(counts, weights, strict=True):
        own = round(w * budget)
        plan.append((n, own // n if n else 0, own % n if n else 0, max(1, -(-n // BLOCK_TOKENS))))
    plans = totals.join(spark.createDataFrame(plan, "n long, passes long, rest long, blocks long"), "n").drop("n")
    sized = F.broadcast if sources <= BROADCAST_SOURCES else lambda df: df

    number = F.expr("cast(conv(substr(mix_place, 1, 8), 16, 10) as long)")

    def place(df: DataFrame) -> DataFrame:
        df = df.withColumn("mix_place", _hashed(seed, doc_id)).join(sized(plans), source.eqNullSafe(F.col("mix_source")), "left")
        return df.withColumn("block", number % F.col("blocks")).withColumn("mix_turn", _hashed(seed, source, F.col("block")))

    placed, light = place(rows), place(light)

    # The block of each source in which the last pass ends, and how many tokens of it are left to take: first the group of
    # blocks whose turns begin alike, then the block within that group.
    sums = light.groupBy("mix_source", "rest", "block", "mix_turn").agg(F.sum("n_tokens").alias("n")).withColumn("mix_group", F.substring("mix_turn", 1, 4))
    sums = scratch.put(sums, "blocks")
    groups = sums.groupBy("mix_source", "rest", "mix_group").agg(F.sum("n").alias("n"))
    groups = groups.withColumn("upto", F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_group").rowsBetween(Window.unboundedPreceding, 0)))
    opened = groups.where("upto > rest").groupBy(F.col("mix_source").alias("own_source")).agg(F.min(F.struct("upto", "mix_group", "n")).alias("g"))
    inner = sums.join(sized(opened), F.col("mix_source").eqNullSafe(F.col("own_source")) & (F.col("mix_group") == F.col("g.mix_group")))
    order = Window.partitionBy("mix_source").orderBy("mix_turn", "block").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("upto", F.col("g.upto") - F.col("g.n") + F.sum("n").over(order))
    ends = inner.where("upto > rest").groupBy(F.col("mix_source").alias("end_source")).agg(F.min(F.struct("upto", "mix_turn", "block", "n", "rest")).alias("e"))
    ends = ends.select("end_source", F.col("e.mix_turn").alias("end_turn"), F.col("e.block").alias("end_block"), (F.col("e.rest") - F.col("e.upto") + F.col("e.n")).alias("left"))
    placed, light = (df.join(sized(ends), F.col("mix_source").eqNullSafe(F.col("end_source")), "left") for df in (placed, light))
    # Within that block documents are taken in the order of their place, those of one place together.
    inside = light.where("block = end_block").groupBy("end_source", "left", "mix_place").agg(F.sum("n_tokens").alias("n"))
    turn = Window.partitionBy("end_source").orderBy("mix_place").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("n").over(turn)).where("upto <= left").groupBy(F.col("end_source").alias("last_source")).agg(F.max("mix_place").alias("last_place"))
    placed = placed.join(sized(last), F.col("mix_source").eqNullSafe(F.col("last_source")), "left")
    before = F.col("end_turn").isNull() | (F.col("mix_turn") < F.col("end_turn")) | ((F.col("block") == F.col("end_block")) & (F.col("mix_place") <= F.coalesce("last_place", F.lit(""))))
    extra = F.when((F.col("rest") > 0) & before, 1).otherwise(0)
    copies = (F.col("passes") + extra).cast("long")
    kept = [F.col(f"mix_row.`{c}`") for c in documents.columns if c not in ("n_tokens", "block", "copies")]
    return placed.select(*kept, "n_tokens", "block", copies.alias("copies"))


def mixed_rows(documents: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mixture itself: each row as often as it is due, with the columns of `documents`."""
    held = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id"), F.col("text"), F.col("source"))
    due = mixture(held, **options).where("copies > 0")
    return due.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
