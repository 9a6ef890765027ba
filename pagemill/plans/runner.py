"""Planning, running and repairing all layouts of a request at once: plans are rows, joined to pages by layout.

The number of jobs does not depend on how many layouts there are. A backend that says `in_tasks` is called where the sketches lie; any other is
called by the driver, which holds DRIVER_ROWS sketches at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.dom import is_element
from pagemill.operators.interpreter import run_plans
from pagemill.operators.staging import staged
from pagemill.operators.validate import validate

from .backend import MOST_REPAIRS, Backend
from .model import Intent, Plan

LAYOUT = ["domain", "pattern"]
#: Layouts that the driver plans at a time.
DRIVER_ROWS = 1_000
_PLANNED = "domain string, pattern string, plan string"


def sketches(ready: DataFrame) -> DataFrame:
    """domain, pattern, sketch (what a backend is shown, as JSON) and the classes in it, of the first page of each layout."""
    firsts = ready.groupBy(*LAYOUT).agg(F.min("page_id").alias("page_id"))
    own = ready.join(firsts, [*LAYOUT, "page_id"]).dropDuplicates(LAYOUT)
    classes = F.flatten(F.transform(F.filter("nodes", is_element), lambda n: F.split(F.coalesce(F.element_at(n["attrs"], F.lit("class")), F.lit("")), r"\s+")))
    keys = F.flatten(F.transform("embedded.payloads", lambda p: F.coalesce(F.json_object_keys(p["json"]), F.array().cast("array<string>"))))
    sketch = F.to_json(F.col("compact").withField("payload_keys", keys))
    return own.select(*LAYOUT, sketch.alias("sketch"), F.filter(F.array_distinct(classes), lambda c: c != "").alias("classes"))


def _asked(rows: DataFrame, ask, in_tasks: bool) -> DataFrame:  # noqa: ANN001
    """`ask(row)` gives a plan as JSON, or None, of each row (domain, pattern and what a backend needs); rows without one are left out."""
    if in_tasks:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(r["domain"], r["pattern"], plan) for r in pdf.to_dict("records") if (plan := ask(r)) is not None], columns=[*LAYOUT, "plan"])

        return rows.mapInPandas(run, _PLANNED)
    spark, out, held = rows.sparkSession, None, []

    def put() -> None:
        nonlocal out
        more = spark.createDataFrame(held, _PLANNED)
        out = more if out is None else out.unionByName(more)
        held.clear()

    for r in rows.toLocalIterator():
        if (plan := ask(r.asDict(recursive=True))) is not None:
            held.append((r.domain, r.pattern, plan))
        if len(held) >= DRIVER_ROWS:
            put()
    if held or out is None:
        put()
    return out


def planned(shown: DataFrame, backend: Backend, intent: Intent) -> DataFrame:
    """domain, pattern, plan of each sketch."""
    ask = lambda r: backend.plan(intent, json.loads(r["sketch"]), list(r["classes"])).to_json()
    return _asked(shown, ask, getattr(backend, "in_tasks", False))


def present_in(plans: DataFrame) -> set[str]:
    """The strategies of a table of plans; there are eight."""
    return {r.s for r in plans.select(F.get_json_object("plan", "$.strategy").alias("s")).distinct().collect()}


def run_pass(pages: DataFrame, intent: Intent, most: int, present: set[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, report, notes) of pages with a plan each; the report has the plan and its strategy."""
    found, notes = run_plans(pages, intent, most, present)
    found = staged(found.select("page_id", "row_idx", "record"))
    jobs = pages.select(F.col("page_id").alias("job_id"), "containers")
    report = validate(jobs, found.select(F.col("page_id").alias("job_id"), "record"), intent)
    used = pages.select(F.col("page_id").alias("job_id"), "plan", F.get_json_object("plan", "$.strategy").alias("strategy"))
    return found, report.join(used, "job_id"), notes


def ran_and_repaired(pages: DataFrame, plans: DataFrame, shown: DataFrame, intent: Intent, backend: Backend, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, report with attempts, notes) of pages under their layout's plan, repaired where that scores higher.

    Of each layout the backend is shown the report of its worst page, and the plan that was tried last; its answer is tried on the layout's pages that
    need a repair. At most MOST_REPAIRS rounds, each of which is the same few jobs for all layouts.
    """
    plans = staged(plans)
    records, report, notes = run_pass(pages.join(plans, LAYOUT), intent, most, present_in(plans))
    report = staged(report.withColumn("attempts", F.lit(0)))
    layouts = pages.select(F.col("page_id").alias("job_id"), *LAYOUT)

    def ask(r: dict) -> str | None:
        plan = backend.repair(intent, Plan.from_json(r["plan"]), json.loads(r["report"]), json.loads(r["sketch"]), list(r["classes"]))
        return None if plan is None else plan.to_json()

    for attempt in range(1, MOST_REPAIRS + 1):
        weak = report.where("needs_repair")
        if not weak.take(1):
            break
        said = F.to_json(F.struct(*(c for c in weak.columns if c not in ("plan", "strategy"))))
        worst = weak.select("job_id", "overall_score", said.alias("report")).join(layouts, "job_id").groupBy(*LAYOUT).agg(F.min_by("report", F.struct("overall_score", "job_id")).alias("report"))
        plans = staged(_asked(worst.join(plans, LAYOUT).join(shown, LAYOUT), ask, getattr(backend, "in_tasks", False)))
        if not plans.take(1):
            break
        before = weak.select("job_id", F.col("overall_score").alias("before"))
        own = pages.join(before.select(F.col("job_id").alias("page_id")), "page_id", "left_semi").join(plans, LAYOUT)
        again, scores, more = run_pass(own, intent, most, present_in(plans))
        better = staged(scores.join(before, "job_id").where("overall_score > before").drop("before").withColumn("attempts", F.lit(attempt)))
        ids = better.select(F.col("job_id").alias("page_id"))
        records = staged(records.join(ids, "page_id", "left_anti").unionByName(again.join(ids, "page_id", "left_semi")))
        report = staged(report.join(better.select("job_id"), "job_id", "left_anti").unionByName(better))
        notes = notes.unionByName(more)
    return records, report, notes
