"""Merging the records of two passes field by field, and choosing the best of several results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.normalize import pick_field, present
from pagemill.plans.model import Intent


def merge_records(standard: DataFrame, semantic: DataFrame, intent: Intent, *, key: str = "job_id") -> DataFrame:
    """(key, row_idx, record) of two record tables, aligned by row_idx; for an object only the first record of each.

    A full outer join on (key, row_idx), so both sides are shuffled once by it and no key need fit in a task. Rows without
    any value are left out.
    """
    if intent.expected == "object":
        standard, semantic = (df.where("row_idx = 0") for df in (standard, semantic))
    joined = standard.select(key, "row_idx", F.col("record").alias("a")).join(semantic.select(key, "row_idx", F.col("record").alias("b")), [key, "row_idx"], "full_outer")
    get = lambda side, name: F.element_at(F.col(side), F.lit(name))
    pairs = F.array(*(F.struct(F.lit(f.name).alias("key"), pick_field(get("a", f.name), get("b", f.name), f.type).alias("value")) for f in intent.fields))
    record = F.map_from_entries(F.filter(pairs, lambda p: present(p["value"])))
    return joined.select(key, "row_idx", record.alias("record")).where(F.size("record") > 0)


#: Results in order of preference where scores are equal.
PREFERENCE = ["merged", "semantic", "standard"]


def best_of(reports: DataFrame, *, key: str = "job_id") -> DataFrame:
    """Of several reports of a job (key, source, overall_score) the best; a pre-aggregated maximum."""
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("source"))
    columns = [c for c in reports.columns if c != key]
    return reports.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("overall_score", -rank)).alias("x")).select(key, "x.*")


def strategy_label(merged_score: Column, standard_score: Column, standard: Column) -> Column:
    """The name of a merged result's strategy: semantic only if it scores strictly higher."""
    return F.when(merged_score > standard_score, "semantic_extraction").otherwise(standard)
