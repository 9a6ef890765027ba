"""Extraction end to end: pages and an instruction (or an intent) to validated records."""

from __future__ import annotations

import functools
import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.embedded import embedded
from pagemill.functions.text import built_once, goal_signature, idempotency_key
from pagemill.functions.urls import normalize_url, url_pattern
from pagemill.operators import jobs, merge, page, strategies, templates, validate
from pagemill.operators.dom import parse_pages, whole_nodes
from pagemill.operators.staging import spread, staged
from pagemill.plans.backend import Backend, RuleBackend
from pagemill.plans.model import ALL_RECORDS, Intent, Options, Plan, check_instruction
from pagemill.plans.runner import LAYOUT, planned, present_in, ran_and_repaired, run_pass, sketches
from pagemill.settings import Settings
from pagemill.sources import artifacts, fetching, render
from pagemill.sources.export import flattened, response_json, write_csv, write_json
from pagemill.sources.store import Store

LOG = logging.getLogger("pagemill.engine")
#: Tasks a core that pages are dealt to.
PIECES = 4
_RECORDS = "page_id long, row_idx int, record map<string,string>"
_DONE = "struct<strategy_used:string,page_type:string,mode:string,records_found:bigint,quality_score:double,field_coverage:map<string,double>,missing_required:array<string>,repair_attempts:int,template_used:boolean,template_id:string,warnings:array<string>>"


@built_once
def _request() -> tuple[Column, dict[str, Column], Column]:
    """The columns of a request that its URL gives."""
    url = F.col("_url")
    first = {"canonical": F.coalesce(url["canonical"], F.col("url")), "domain": F.coalesce(url["domain"], F.lit("")), "invalid_url": url["error"].isNotNull()}
    return normalize_url(F.col("url")), first, F.coalesce(url_pattern(F.col("canonical")), F.lit("/"))


@built_once
def _embedded() -> Column:
    return embedded(F.col("html"))


@dataclass
class Result:
    """Of one extraction: records (page_id, row_idx, record), a report for each page, and how they came about.

    jobs has a row for each page: its job, status, diagnostics and message; cached ones were answered before. plan is the one that was given, or that
    of the first page; plans has (page_id, plan) of the pages that were worked on, and notes what went wrong in them.
    """

    records: DataFrame
    report: DataFrame
    intent: Intent
    plan: Plan | None
    repairs: int
    jobs: DataFrame | None = None
    plans: DataFrame | None = None
    notes: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)

    def table(self) -> DataFrame:
        """The records with a column a field, in the types of the intent."""
        kinds = {f.name: f.dataType for f in self.intent.schema().fields}
        own = self.records.select("page_id", "row_idx", *(F.element_at("record", F.lit(n)).alias(n) for n in kinds))
        cast = lambda n, k: F.split(n, "; ") if k.typeName() == "array" else F.col(n).try_cast(k)
        return own.select("page_id", "row_idx", *(cast(n, k).alias(n) for n, k in kinds.items()))

    def csv(self) -> DataFrame:
        return flattened(self.records, [f.name for f in self.intent.fields])

    def statuses(self) -> DataFrame:
        return self.report.select("job_id", validate.response_status(F.col("is_good_enough"), F.col("n_records"), F.col("overall_score")).alias("status"), "overall_score", "repair_hint")

    def responses(self) -> DataFrame:
        """The envelope of each page: job_id, url, instruction, status, message, diagnostics, and records as a list whatever the intent."""
        own = self.records.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.to_json("record").alias("r")))), lambda x: x["r"]).alias("records"))
        return self.jobs.join(own, "page_id", "left").withColumn("records", F.coalesce("records", F.array().cast("array<string>")))

    def response_json(self) -> DataFrame:
        return response_json(self.responses().withColumn("records", F.transform("records", lambda r: F.from_json(r, "map<string,string>"))))

    def save_csv(self, path: str, mode: str = "overwrite") -> None:
        write_csv(self.csv(), path, mode)

    def save_json(self, path: str, mode: str = "overwrite") -> None:
        write_json(self.table(), path, mode)

    def show(self, n: int = 20) -> None:
        self.table().show(n, truncate=False)


class Engine:
    """Plans once for the pages of one layout (domain and URL pattern) and runs each plan over all pages that share it.

    With a store, pages whose request was answered before are not worked on again, plans that worked are used again
    without planning, and jobs, results and templates are kept. It is a context manager; closing it frees nothing of Spark's.
    """

    def __init__(self, spark: SparkSession, backend: Backend | None = None, *, store: Store | None = None, settings: Settings | None = None, opener: render.Opener | None = None, artifacts_path: str | None = None) -> None:
        self.spark, self.backend, self.store = spark, backend or RuleBackend(), store
        self.settings, self.opener, self.artifacts_path = settings or Settings.from_spark(spark), opener, artifacts_path
        LOG.setLevel(self.settings.log_level)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def close(self) -> None:
        """Stops writing to the store; the session belongs to the caller."""
        self.store = None

    def templates(self, status: str | None = None) -> DataFrame:
        return jobs.templates_by_use(self._store().table("templates"), status)

    def metrics(self) -> tuple[DataFrame, DataFrame]:
        """Counters (jobs by status) and histograms (quality by page type) of the store."""
        own = self._store().table("jobs")
        counters = own.groupBy(F.concat(F.lit("extraction_total{status="), F.col("status"), F.lit("}")).alias("key")).agg(F.count("*").cast("double").alias("total"))
        from pagemill.operators.metrics import histograms

        return counters, histograms(own.select("page_type", F.col("quality_score").alias("value")), ["page_type"])

    def _store(self) -> Store:
        if self.store is None:
            raise ValueError("the engine has no store")
        return self.store

    def prepared(self, pages: DataFrame) -> DataFrame:
        """Pages (page_id, url, html) parsed and analysed once: their request, nodes, embedded data, compact form and what a report needs of it. Few large pages are dealt over all cores; long ones have their nodes packed (see `parse_pages`)."""
        pages = spread(pages, "page_id", PIECES)
        most = self.settings.max_html_bytes
        long = F.octet_length("html") > most if most else F.lit(False)
        html = F.when(long, F.make_valid_utf8(F.substring(F.col("html").cast("binary"), 1, most).cast("string"))).otherwise(F.col("html"))
        rows = pages.withColumn("html_truncated", F.coalesce(long, F.lit(False))).withColumn("html", html).withColumns({"markup_length": F.length("html"), "embedded": _embedded()})
        rows = page.analyze(parse_pages(rows, "html", "nodes", False, None, "packed")).drop("text_length")
        return rows.withColumn("containers", page.dom.first(F.col("compact.candidate_sections"))["count"].cast("int"))

    def requests(self, pages: DataFrame, instruction: str, intent: Intent) -> DataFrame:
        """`pages` with canonical, domain, pattern, idempotency_key and goal_signature; no_url where the URL is none."""
        whole, parts, pattern = _request()
        rows = pages.withColumn("_url", whole).withColumns(parts).drop("_url")
        signature = goal_signature(F.array(*(F.lit(f.name) for f in intent.fields)))
        return rows.withColumns({"pattern": pattern, "idempotency_key": idempotency_key(F.col("url"), F.lit(instruction)), "goal_signature": signature})

    def extract(self, pages: DataFrame, instruction: str | None = None, *, intent: Intent | None = None, plan: Plan | None = None, options: Options | None = None, semantic: bool | None = None, extractor: Callable[[str, Intent, int], list[dict]] | None = None) -> Result:
        """Records of pages (page_id, url, html).

        `plan` skips planning. The facts' records are merged in, and the better result of each page is kept, for objects, for pages
        that are not good enough or were repaired (`semantic` None), for all (True) or for none (False); `extractor` reads them
        instead of the rules. With Options.use_browser "auto" pages whose static HTML is not enough are rendered, if the engine can.
        """
        options = options or Options()
        most = min(options.max_records or ALL_RECORDS, self.settings.max_records or ALL_RECORDS)
        if intent is None:
            check_instruction(instruction or "")
            intent = self.backend.intent(instruction)
        asked = self.requests(pages, instruction or intent.entity, intent)
        asked = asked.withColumn("cached_job_id", F.lit(None).cast("string")) if self.store is None else jobs.finished(asked, self.store.lookup("jobs", "idempotency_key", asked.select("idempotency_key")))
        asked = staged(asked)
        todo = asked.where("cached_job_id is null")
        warm = self.store is not None and plan is None
        none = F.lit(None).cast("string")
        # Templates are looked up by requests, before the parse: columns over parsed pages bring the parse with them.
        todo = self._matched(todo) if warm else todo.withColumns({"template_id": none, "template_plan": none})
        ready = staged(self._rendered(self.prepared(todo), todo, intent, options))
        how = {"attempts": F.lit(0), "template_used": F.lit(True)}

        # The warm path: pages with a template. Those that it does not serve well are planned like the others.
        cold, done = ready, []
        known = ready.where("template_id is not null").withColumn("plan", F.col("template_plan"))
        if warm and known.take(1):
            found, report, notes = run_pass(known, intent, most, present_in(known))
            report = staged(report.withColumns(how))
            self._advance(known, report)
            good = report.where("is_good_enough")
            done.append((found.join(good.select(F.col("job_id").alias("page_id")), "page_id", "left_semi"), good, notes))
            cold = ready.join(good.select(F.col("job_id").alias("page_id")), "page_id", "left_anti")
        if fresh := not done or bool(cold.take(1)):
            cold = staged(cold) if done else cold
            shown = staged(sketches(cold))
            plans = shown.select(*LAYOUT, F.lit(plan.to_json()).alias("plan")) if plan is not None else planned(shown, self.backend, intent)
            found, report, notes = ran_and_repaired(cold, plans, shown, intent, self.backend, most)
            done.append((found, report.withColumn("template_used", F.lit(False)), notes))
        records, reports, notes = (functools.reduce(DataFrame.unionByName, parts) for parts in zip(*done, strict=True))
        reports = staged(reports) if len(done) > 1 else reports
        if semantic is not False and fresh:
            gate = F.lit(True) if semantic else F.lit(intent.expected == "object") | ~F.col("is_good_enough") | (F.col("attempts") > 0)
            records, reports = self._with_semantic(ready, records, reports, gate & ~F.col("template_used"), intent, most, extractor)
        warnings: list[str] = []
        out = self._kept(asked, ready, records, reports, notes, instruction or intent.entity, intent, options if fresh else replace(options, save_template=False), warnings)
        first = reports.orderBy("job_id").select("plan").first() if plan is None else None
        repairs = reports.agg(F.max("attempts")).first()[0] or 0
        used = Plan.from_json(first.plan) if first else plan
        LOG.info("extraction: at most %d repairs", repairs)
        return Result(out[0], reports.drop("attempts", "strategy", "plan", "template_used"), intent, used, repairs, out[1], reports.select(F.col("job_id").alias("page_id"), "plan"), notes, warnings)

    def extract_urls(self, urls: DataFrame, instruction: str | None = None, *, fetch: fetching.Fetch | None = None, resolve: Callable[[str], list[str]] = fetching.system_resolve, robots: Callable[[str], str | None] | None = None, clock: fetching.Clock | None = None, **options: object) -> Result:
        """URL in, records out: the pages of `urls` (page_id, url) are fetched as the settings allow and extracted. Those that are not to be had are jobs that failed, with the reason as their message."""
        pages = staged(fetching.fetch_pages(urls, self.settings, fetch=fetch, resolve=resolve, robots=robots, clock=clock))
        result = self.extract(pages.where("error is null").select("page_id", "url", "html"), instruction, **options)
        failed = pages.where("error is not null").join(urls.select("page_id", F.col("url").alias("asked")), "page_id")
        by = {f.name: f.dataType for f in result.jobs.schema.fields}
        said = {"page_id": F.col("page_id"), "job_id": F.substring(F.sha2(F.concat_ws("|", "asked", "page_id", F.current_timestamp()), 256), 1, 32), "url": F.col("asked"), "instruction": F.lit(instruction), "status": F.lit("failed"), "message": F.col("error")}
        rows = failed.select(*(said.get(n, F.lit(None)).cast(t).alias(n) for n, t in by.items()))
        if self.store is not None:
            now = F.current_timestamp().cast("timestamp_ntz")
            known = {"id": said["job_id"], "url": F.col("asked"), "instruction": F.lit(instruction), "idempotency_key": idempotency_key(F.col("asked"), F.lit(instruction or "")), "status": F.lit("failed"), "error_code": F.split("error", ":")[0], "error_message": F.col("error"), "created_at": now, "updated_at": now}
            self.store.append("jobs", failed.select(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in jobs.JOBS.split(", ")))))
        return replace(result, jobs=result.jobs.unionByName(rows))

    # --- steps -----------------------------------------------------------------------------------------------------

    def _rendered(self, ready: DataFrame, todo: DataFrame, intent: Intent, options: Options) -> DataFrame:
        ready = ready.withColumn("mode", F.lit("static"))
        if self.opener is None or options.use_browser == "never":
            return ready
        ready = staged(ready)
        enough = F.lit(False) if options.use_browser == "force" else page.static_is_enough(F.col("compact"), F.col("embedded"), intent.expected, intent.required)
        poor = ready.where(~F.coalesce(enough, F.lit(False))).select("page_id")
        wanted = todo.join(poor, "page_id", "left_semi")
        found = staged(render.rendered(wanted, self.opener)).where("rendered_html is not null")
        again = self.prepared(todo.join(found.select("page_id", "rendered_html"), "page_id").withColumn("html", F.col("rendered_html")).drop("rendered_html")).withColumn("mode", F.lit("browser"))
        return ready.join(found.select("page_id"), "page_id", "left_anti").unionByName(again)

    def _matched(self, asked: DataFrame) -> DataFrame:
        """Requests with template_id and template_plan, or null."""
        known = self.store.lookup("templates", "domain", asked.select("domain"))
        found = templates.match_templates(asked.select(F.col("page_id").alias("job_id"), "domain", "goal_signature", "canonical"), known)
        found = found.where("template_id is not null").join(known.select(F.col("id").alias("template_id"), F.col("extraction_plan").alias("template_plan")), "template_id")
        return asked.join(found.select(F.col("job_id").alias("page_id"), "template_id", "template_plan"), "page_id", "left")

    def _advance(self, known: DataFrame, report: DataFrame) -> None:
        """Each page is one more result of its template, in order of page_id."""
        results = known.select(F.col("page_id").alias("job_id"), "template_id").join(report, "job_id").select("template_id", F.col("job_id").alias("ts"), F.col("is_good_enough").alias("success"), F.col("overall_score").alias("score"))
        rows = self.store.by_id("templates", results.select(F.col("template_id").alias("id")))
        states = rows.select(F.col("id").alias("template_id"), "status", F.col("consecutive_successes").alias("successes"), F.col("consecutive_failures").alias("failures"), F.col("success_score").alias("score"))
        new = templates.advanced(states, results, order=("ts",)).select(F.col("template_id").alias("id"), F.struct("status", "successes", "failures", "score").alias("_s"))
        now = F.current_timestamp().cast("timestamp_ntz")
        rows = rows.join(new, "id").withColumns({"status": F.col("_s.status"), "consecutive_successes": F.col("_s.successes"), "consecutive_failures": F.col("_s.failures"), "success_score": F.col("_s.score"), "updated_at": now, "last_used_at": now}).drop("_s")
        self.store.append("templates", staged(rows))

    def _with_semantic(self, ready: DataFrame, records: DataFrame, reports: DataFrame, gate: Column, intent: Intent, most: int, extractor: Callable | None) -> tuple[DataFrame, DataFrame]:
        chosen = staged(reports.where(gate).select("job_id"))
        if not chosen.take(1):
            return records, reports
        picked = ready.join(chosen.select(F.col("job_id").alias("page_id")), "page_id", "left_semi")
        own = whole_nodes(picked).withColumn("facts", page.facts(F.col("nodes"), F.col("url"), F.col("embedded")))
        facts = strategies.execute(own, Plan("semantic_extraction"), intent, most) if extractor is None else strategies.semantic_by(own, intent, extractor, most)
        facts = staged(facts.select("page_id", "row_idx", "record"))
        standard = records.join(chosen.select(F.col("job_id").alias("page_id")), "page_id", "left_semi")
        tables = {"standard": standard, "semantic": facts, "merged": staged(merge.merge_records(standard, facts, intent, key="page_id"))}
        pages = picked.select(F.col("page_id").alias("job_id"), "containers")
        before = reports.join(chosen, "job_id", "left_semi")
        extra = before.select("job_id", "attempts", "plan", "template_used", F.col("strategy").alias("standard_strategy"), F.col("overall_score").alias("standard_score"))
        every, rows = None, None
        for source, table in tables.items():
            r = validate.validate(pages, table.select(F.col("page_id").alias("job_id"), "record"), intent).withColumn("source", F.lit(source))
            every = r if every is None else every.unionByName(r)
            table = table.withColumn("source", F.lit(source))
            rows = table if rows is None else rows.unionByName(table)
        every = staged(every)
        semantic_score = every.where("source = 'semantic'").select("job_id", F.col("overall_score").alias("semantic_score"))
        best = merge.best_of(every).join(extra, "job_id").join(semantic_score, "job_id")
        label = F.when(F.col("source") == "semantic", "semantic_extraction").when(F.col("source") == "merged", merge.strategy_label(F.col("semantic_score"), F.col("standard_score"), F.col("standard_strategy"))).otherwise(F.col("standard_strategy"))
        best = staged(best.withColumn("strategy", label))
        taken = rows.join(best.select(F.col("job_id").alias("page_id"), "source"), ["page_id", "source"]).select("page_id", "row_idx", "record")
        rest = records.join(chosen.select(F.col("job_id").alias("page_id")), "page_id", "left_anti")
        return staged(rest.unionByName(taken)), staged(reports.join(chosen, "job_id", "left_anti").unionByName(best.select(*reports.columns)))

    def _kept(self, asked: DataFrame, ready: DataFrame, records: DataFrame, reports: DataFrame, notes: DataFrame, instruction: str, intent: Intent, options: Options, warnings: list[str]) -> tuple[DataFrame, DataFrame]:
        """Records with those of answered requests, and a job for each page; what is new goes to the store."""
        counts = records.select("page_id", F.explode(F.map_keys("record")).alias("f")).groupBy("page_id", "f").count()
        share = counts.join(reports.select(F.col("job_id").alias("page_id"), "n_records"), "page_id")
        share = share.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", F.try_divide("count", "n_records"))))).alias("field_coverage"))
        lacking = F.filter(F.map_keys("missing"), lambda f: f.isin(intent.required)) if intent.required else F.array().cast("array<string>")
        nothing = F.array().cast("array<string>")
        note = F.when(~F.col("is_good_enough") & (F.col("n_records") == 0) & (F.col("overall_score") < 0.1), F.array(F.lit("no records were found; look at the page's compact form"))).otherwise(nothing)
        note = F.concat(F.when(F.col("html_truncated"), F.array(F.lit("html_truncated"))).otherwise(nothing), F.coalesce("notes", nothing), note)
        done = reports.join(ready.select(F.col("page_id").alias("job_id"), F.col("page_id"), F.col("compact.page_type_hint").alias("page_type"), "mode", "template_id", "html_truncated"), "job_id").join(share, "page_id", "left")
        said = notes.groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list("notes"))).alias("notes"))  # a few rows a page
        done = done.join(said, "page_id", "left")
        diagnostics = F.struct(
            F.col("strategy").alias("strategy_used"), "page_type", "mode", F.col("n_records").alias("records_found"), F.col("overall_score").alias("quality_score"), F.coalesce("field_coverage", F.create_map().cast("map<string,double>")).alias("field_coverage"),
            lacking.alias("missing_required"), F.col("attempts").cast("int").alias("repair_attempts"), "template_used", F.when(F.col("template_used"), F.col("template_id")).alias("template_id"), note.alias("warnings"),
        )
        status = validate.response_status(F.col("is_good_enough"), F.col("n_records"), F.col("overall_score"))
        done = done.select("page_id", status.alias("status"), diagnostics.alias("diagnostics"), F.when(~F.col("is_good_enough"), F.col("repair_hint")).alias("message"), "plan", "is_good_enough")
        new = asked.where("cached_job_id is null").join(done, "page_id").withColumn("job_id", F.substring(F.sha2(F.concat_ws("|", "idempotency_key", F.col("page_id").cast("string"), F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS")), 256), 1, 32))
        new = staged(new.drop("html"))
        if self.artifacts_path is not None:
            tables = [artifacts.artifact(new, "plan", F.col("plan")), artifacts.artifact(new, "result", F.col("diagnostics")), artifacts.artifact(ready.withColumn("job_id", F.col("page_id")), "compact", F.col("compact"))]
            if not artifacts.write_artifacts(self.artifacts_path, *tables):
                warnings.append("artifacts_not_written")
        shown = ["page_id", "job_id", "url", "instruction", "status", "message", "diagnostics"]
        fresh = new.withColumn("instruction", F.lit(instruction)).select(*shown)
        if self.store is None:
            return records, fresh
        now = F.current_timestamp().cast("timestamp_ntz")
        d = F.col("diagnostics")
        self.store.append("jobs", new.select(
            F.col("job_id").alias("id"), "url", "domain", F.lit(instruction).alias("instruction"), "idempotency_key", "status", d["page_type"].alias("page_type"), d["strategy_used"].alias("strategy_used"), F.lit(options.output_format).alias("output_format"),
            d["quality_score"].alias("quality_score"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("int").alias("runtime_ms"), d["repair_attempts"].alias("repair_attempts"), d["template_id"].alias("template_id"), now.alias("created_at"), now.alias("updated_at"),
        ))
        listed = records.groupBy("page_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.to_json("record").alias("r")))), lambda x: x["r"])).alias("records"))
        own = new.join(listed, "page_id", "left")
        self.store.append("results", own.select(F.concat(F.lit("r-"), F.col("job_id")).alias("id"), "job_id", F.coalesce("records", F.lit("[]")).alias("records"), F.to_json("diagnostics").alias("diagnostics"), now.alias("created_at")))
        if options.save_template:
            self._save_templates(new, now)
        old = asked.where("cached_job_id is not null").drop("html")
        if not old.take(1):
            return records, fresh
        # Answered requests: what their latest result holds, without any work on the page.
        before = jobs.with_results(self.store.by_id("jobs", old.select(F.col("cached_job_id").alias("id"))), self.store.lookup("results", "job_id", old.select("cached_job_id"))).select(F.col("id").alias("cached_job_id"), "status", "records", F.from_json("diagnostics", _DONE).alias("diagnostics"))
        old = staged(old.join(before, "cached_job_id"))
        again = old.select("page_id", F.posexplode(F.from_json("records", "array<string>")).alias("row_idx", "r")).select("page_id", "row_idx", F.from_json("r", "map<string,string>").alias("record"))
        cached = old.select("page_id", F.col("cached_job_id").alias("job_id"), "url", F.lit(instruction).alias("instruction"), "status", F.lit("cached_idempotent_response").alias("message"), "diagnostics")
        return records.unionByName(again), fresh.unionByName(cached)

    def _save_templates(self, new: DataFrame, now: Column) -> None:
        """A candidate for each layout that did well by a plan of its own and has no template yet."""
        good = new.where(F.col("is_good_enough") & ~F.col("diagnostics.template_used") & ~F.col("invalid_url"))
        best = good.groupBy("domain", "goal_signature", "pattern").agg(F.max_by(F.struct("plan", "diagnostics.strategy_used", "diagnostics.page_type", "diagnostics.quality_score"), F.struct("diagnostics.quality_score", -F.col("page_id"))).alias("x"))
        rows = best.select(
            F.substring(F.sha2(F.concat_ws("|", "domain", "goal_signature", "pattern"), 256), 1, 32).alias("id"), "domain", F.col("pattern").alias("url_pattern"), "goal_signature", F.col("x.page_type").alias("page_type"), F.col("x.strategy_used").alias("strategy"),
            F.when(F.col("x.strategy_used") == "semantic_extraction", F.lit(Plan("semantic_extraction").to_json())).otherwise(F.col("x.plan")).alias("extraction_plan"), F.col("x.quality_score").alias("success_score"), F.lit("candidate").alias("status"),
            F.lit(1).alias("consecutive_successes"), F.lit(0).alias("consecutive_failures"), now.alias("created_at"), now.alias("updated_at"), now.alias("last_used_at"),
        )
        known = self.store.lookup("templates", "domain", rows.select("domain")).where("status <> 'deprecated'").select("domain", "goal_signature", "url_pattern")
        self.store.append("templates", staged(rows.join(known, ["domain", "goal_signature", "url_pattern"], "left_anti")))

    def follow(self, first: Result, link: str, fetch: Callable[[DataFrame], DataFrame], instruction: str | None = None, **options: object) -> Result:
        """A second extraction over the pages that a field of a first one links to: `fetch` gives (page_id, url, html) of (page_id, url), an id for each distinct URL."""
        urls = first.records.select(F.element_at("record", F.lit(link)).alias("url")).where(F.col("url").rlike("^(?i)https?://")).distinct()
        return self.extract(fetch(urls.select(F.xxhash64("url").alias("page_id"), "url")), instruction, **options)


def extract(spark: SparkSession, pages: DataFrame, instruction: str, **options: object) -> Result:
    """One extraction with an engine of its own: engine settings and extract's options by name."""
    own = {k: options.pop(k) for k in ("backend", "store", "settings", "opener", "artifacts_path") if k in options}
    with Engine(spark, **own) as engine:
        return engine.extract(pages, instruction, **options)


def describe(plan: Plan) -> str:
    """A plan as indented JSON."""
    return json.dumps(asdict(replace(plan)), indent=2)
