"""Debug artifacts of jobs (HTML, compact pages, plans, reports, errors) as one Parquet table by kind, and dumps of metrics."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["html", "compact", "intent", "plan", "validation", "result", "screenshot", "llm", "error"]
_LOG = logging.getLogger("pagemill.artifacts")


def artifact(rows: DataFrame, kind: str, body: Column, *, step: int = 1, name: Column | None = None) -> DataFrame:
    """(job_id, kind, step, name, body) of rows that have a job_id; a body that is no string is written as JSON."""
    if kind not in KINDS:
        raise ValueError(f"artifact kind {kind!r}")
    text = body if isinstance(rows.select(body).schema[0].dataType, (T.StringType, T.BinaryType)) else F.to_json(body)
    return rows.select(F.col("job_id").cast("string").alias("job_id"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), (F.lit(f"{kind}.{step}") if name is None else name).alias("name"), text.cast("binary").alias("body"))


def write_artifacts(path: str, *tables: DataFrame) -> bool:
    """Appends artifacts below kind=.../ of a path. A failed write is logged and not raised; says whether it went well."""
    try:
        out = tables[0]
        for df in tables[1:]:
            out = out.unionByName(df)
        out.write.mode("append").partitionBy("kind").parquet(path)
    except Exception as e:  # noqa: BLE001
        _LOG.warning("artifacts were not written to %s: %s", path, str(e)[:200])
        return False
    return True


def read_artifacts(spark, path: str, job_id: str | None = None) -> DataFrame:  # noqa: ANN001
    """The artifacts under a path, or those of one job; the kind is a partition."""
    rows = spark.read.parquet(path)
    return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def dump_metrics(counters: DataFrame, histograms: DataFrame, path: str) -> None:
    """A snapshot of metrics as JSON lines: counters (key, total) and histograms (key and their summary)."""
    both = counters.withColumn("metric", F.lit("counter")).unionByName(histograms.withColumn("metric", F.lit("histogram")), allowMissingColumns=True)
    both.write.mode("overwrite").json(path)
