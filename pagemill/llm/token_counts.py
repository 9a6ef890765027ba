"""Exact length histogram: token counts of a corpus for every context limit.

Documents are aggregated by encoded length; suffix sums over the histogram then give, for every limit that
is some document's length, what any limit needs: totals, rank quantiles and totals after truncation.

Scale: the only shuffle is of (length, count), pre-aggregated; the histogram has a row for each distinct length, and is
staged, so that texts are encoded once. The sums run over blocks of lengths, so no task holds the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import Scratch

#: Lengths that one block of the sums spans.
BLOCK = 1024


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """For each distinct length L of `lengths`, ascending in meaning, not in order:

    n_tokens; n_docs of that length; docs_within and tokens_within (length <= L); docs_over and
    tokens_over (length > L); truncated_tokens: the total if every document is cut at L; rank: docs_within /
    all, the quantile that L is. Rows with a null length are left out; an empty table gives no rows.
    """
    counts = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    counts = Scratch(lengths.sparkSession, "lengths").put(counts, "counts")
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy("block")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    offsets = blocks.select("block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"), F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("all_tokens"))
    inner = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumns({"d_in": F.sum("n_docs").over(inner), "t_in": F.sum("tokens").over(inner)}).join(offsets, "block")
    out = out.withColumns({"docs_within": F.col("d_before") + F.col("d_in"), "tokens_within": F.col("t_before") + F.col("t_in")})
    out = out.withColumns({"docs_over": F.col("docs") - F.col("docs_within"), "tokens_over": F.col("all_tokens") - F.col("tokens_within")})
    return out.select("n_tokens", "n_docs", "docs_within", "tokens_within", "docs_over", "tokens_over", (F.col("tokens_within") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"), (F.col("docs_within") / F.col("docs")).alias("rank"))


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per limit: docs_within, docs_over, tokens kept whole, and truncated_tokens, answered from the histogram alone.

    A limit between two lengths takes the row of the largest length within it; below all lengths nothing is whole.
    """
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    totals = histogram.agg(F.sum("n_docs").alias("docs"))
    found = F.broadcast(asked).join(histogram, F.col("n_tokens") <= F.col("context_limit"), "left")
    best = found.groupBy("context_limit").agg(F.max(F.struct("n_tokens", "docs_within", "tokens_within")).alias("x")).crossJoin(totals)  # totals: one row
    within = F.coalesce("x.docs_within", F.lit(0))
    kept = F.coalesce("x.tokens_within", F.lit(0))
    over = F.coalesce("docs", F.lit(0)) - within
    return best.select("context_limit", within.alias("docs_within"), over.alias("docs_over"), kept.alias("tokens_within"), (kept + F.col("context_limit") * over).alias("truncated_tokens"))


def length_quantiles(histogram: DataFrame, ranks: list[float]) -> DataFrame:
    """Per rank q in (0, 1]: the smallest length that at least q of the documents do not exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(q),) for q in ranks], "q double")
    return F.broadcast(asked).join(histogram, F.col("rank") >= F.col("q")).groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))
