"""Jobs and results: append-only tables of events, with the latest row of a key as the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments

JOBS = "id string, url string, domain string, instruction string, idempotency_key string, status string, page_type string, strategy_used string, output_format string, quality_score double, error_code string, error_message string, runtime_ms int, repair_attempts int, template_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
RESULTS = "id string, job_id string, records string, diagnostics string, created_at timestamp_ntz"
TEMPLATES = "id string, domain string, url_pattern string, goal_signature string, page_type string, strategy string, extraction_plan string, success_score double, status string, consecutive_successes int, consecutive_failures int, created_at timestamp_ntz, updated_at timestamp_ntz, last_used_at timestamp_ntz"
ARTIFACTS = "id string, job_id string, artifact_type string, storage_url string, created_at timestamp_ntz"


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns: a pre-aggregated maximum, not a window, so hot keys do not gather."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("x")).select("x.*")


def finished(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with cached_job_id: that of the latest successful or partly successful job of the same key, or null."""
    done = latest(jobs.where(F.col("status").isin("success", "partial_success")), ["idempotency_key"], ["created_at", "id"])
    return requests.join(done.select("idempotency_key", F.col("id").alias("cached_job_id")), "idempotency_key", "left")


def unfinished(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests that no successful job has answered."""
    done = jobs.where(F.col("status").isin("success", "partial_success")).select("idempotency_key").distinct()
    return requests.join(done, "idempotency_key", "left_anti")


def with_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with the records and diagnostics of their latest result."""
    own = latest(results, ["job_id"], ["created_at", "id"]).select(F.col("job_id").alias("id"), "records", "diagnostics")
    return jobs.join(own, "id", "left")


def templates_by_use(templates: DataFrame, status: str | None = None) -> DataFrame:
    """All templates, or those of a status, the last used first."""
    rows = templates if status is None else templates.where(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("last_used_at"), "id")


def rate_schedule(arrivals: DataFrame, *, rate: float = 1.0, burst: int = 1, wait: float | None = None, key: str = "domain") -> DataFrame:
    """When each arrival (key, at: seconds, seq) may start under a token bucket of a key: `rate` tokens a second, at most `burst` saved up.

    In closed form: a bucket that owes i tokens by then frees at i / rate + the running maximum of (arrival - i / rate), less what a
    burst may run ahead; with burst 1 that is max(arrival, previous start + 1 / rate). With `wait` given_up says that a
    start would come later than that; the token of such an arrival still counts. A key's arrivals are a chain of
    segments, so that one with very many is dealt over many tasks.
    """
    columns, order = arrivals.columns, ("at", "seq")
    by = segments.within(key, order)
    rows = segments.segmented(arrivals, key, order).withColumn("_i", F.row_number().over(by) - 1)
    rows = rows.withColumn("_due", F.col("at") - F.col("_i") / rate)
    rows = rows.withColumn("_before", F.max("_due").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    # What a segment hands on: how many arrivals it has, and its maximum.
    along = segments.along(key).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(segments.SEGMENT, key).agg(F.count("*").alias("_n"), F.max("_due").alias("_most"))
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    ends = ends.withColumn("_earlier", F.max(F.col("_most") - F.col("_offset") / rate).over(along))
    carries = ends.where("_offset > 0").select(segments.SEGMENT, key, "_offset", "_earlier")
    rows = segments.carried(rows, key, carries)
    offset = F.coalesce("_offset", F.lit(0))
    before = F.greatest(F.col("_before") - offset / rate, F.col("_earlier"))  # nulls do not count
    start = F.greatest(F.col("at"), before + (F.col("_i") + offset) / rate - (burst - 1) / rate)
    rows = rows.withColumn("start", start).select(*columns, "start")
    return rows if wait is None else rows.withColumn("given_up", ~within_deadline(F.col("start"), F.col("at"), wait))


def remaining(deadline: Column, now: Column, step: Column | float | None = None) -> Column:
    """Seconds of a budget that are left, never below 0; no more than a step may take."""
    left = F.greatest(deadline - now, F.lit(0.0))
    return left if step is None else F.least(left, step if isinstance(step, Column) else F.lit(step))


def within_deadline(start: Column, arrival: Column, seconds: float = 5.0) -> Column:
    """Whether a start comes before the wait is given up."""
    return start - arrival <= seconds
