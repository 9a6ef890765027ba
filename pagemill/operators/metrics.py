"""Counters and histograms over metric events (name, labels map, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_key(name: Column, labels: Column) -> Column:
    """name{a=1,b=2}, labels sorted; the name alone without labels."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>")))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return F.when(pairs == "", name).otherwise(F.concat(name, F.lit("{"), pairs, F.lit("}")))


def counters(events: DataFrame) -> DataFrame:
    """The sum of each name and set of labels."""
    return events.groupBy(label_key(F.col("name"), F.col("labels")).alias("key")).agg(F.sum("value").alias("total"))


def counter_total(events: DataFrame, prefix: str, *, by: str = "job_id") -> DataFrame:
    """The sum of the counters whose name starts with a prefix, for each job."""
    return events.where(F.col("name").startswith(prefix)).groupBy(by).agg(F.sum("value").alias("total"))


def histograms(events: DataFrame, keys: list[str]) -> DataFrame:
    """count, min, max, mean, p50, p95, p99 of value by key: the values at int(n/2) and min(n - 1, int(n q)) of the sorted ones.

    Values are counted before they are sorted, and places are found by running counts, so a hot key is as many rows as it has
    distinct values.
    """
    counts = events.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("upto", F.sum("c").over(by)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = {"p50": F.floor(F.col("n") * 0.5), **{f"p{q}": F.least(F.col("n") - 1, F.floor(F.col("n") * (q / 100))) for q in (95, 99)}}
    here = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    return rows.groupBy(*keys).agg(F.max("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("c")) / F.max("n")).alias("mean"), *(here(p).alias(name) for name, p in at.items()))
