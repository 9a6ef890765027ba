"""Backends that turn an instruction into an intent and a page into a plan; and the repair loop.

A backend may call a language model; the one here is deterministic and needs no network. It looks at what a page
is made of (its compact form) and takes the first strategy that fits.
"""

from __future__ import annotations

import json
import re
from dataclasses import replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import field_term
from pagemill.operators.staging import staged
from pagemill.operators.strategies import execute
from pagemill.operators.validate import validate

from .model import STRATEGIES, FieldSelector, FieldSpec, Intent, Plan

#: Repairs of a plan at most.
MOST_REPAIRS = 2
_KINDS = [("price|cost|amount", "currency"), ("url|link|href", "url"), ("e-?mail", "email"), ("phone|tel", "phone"), ("date|published|deadline", "date"), ("rating|score|percent", "number"), ("count|number of|quantity|year", "integer"), ("available|in stock|is_", "boolean"), ("tags|categories", "list_string")]
_TEXT_PATTERNS = {"email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "currency": r"([$€£¥₹]\s?\d+(?:[.,]\d+)?)", "phone": r"(\+?\d[\d ()-]{6,18}\d)", "date": r"(\d{4}-\d{2}-\d{2})", "url": r"(https?://[^\s<>\"]+)", "number": r"(-?\d+(?:[.,]\d+)?)", "integer": r"(-?\d+)"}


class Backend(Protocol):
    """What plans extractions."""

    def intent(self, instruction: str) -> Intent: ...

    def plan(self, intent: Intent, compact: dict[str, Any], classes: list[str]) -> Plan: ...

    def repair(self, intent: Intent, plan: Plan, report: dict[str, Any], compact: dict[str, Any], classes: list[str]) -> Plan | None: ...


def kind_of(name: str) -> str:
    """A field's type by its name."""
    return next((kind for pattern, kind in _KINDS if re.search(pattern, field_term(name))), "string")


#: How names of models begin that take no temperature.
REASONING_MODELS = ("gpt-5", "o1", "o3", "o4")

#: What a language model is asked, a template a step; filled with str.format.
PROMPTS = {
    "intent": "Which fields does this request ask for? Answer as JSON with entity, expected (object or array) and fields (name, type, required).\nRequest: {instruction}",
    "plan": "Choose how to extract these fields from the page described. Answer as JSON with strategy and what it needs.\nStrategies: {strategies}\nFields: {fields}\nPage: {compact}",
    "repair": "This plan did badly. Answer with a better one in the same form.\nFields: {fields}\nPlan: {plan}\nReport: {report}\nPage: {compact}",
    "semantic": "Answer with a JSON list of at most {most} records of these fields, from the facts alone; leave out what they do not say.\nFields: {fields}\nFacts:\n{facts}",
}


def is_reasoning_model(name: str) -> bool:
    """Whether a model is one of those that take no temperature."""
    return name.lower().startswith(REASONING_MODELS)


class GatewayError(RuntimeError):
    """A model that could not be reached, or whose answer was of no use twice."""


class Gateway:
    """Asks a model for JSON and checks the answer; a bad answer is asked for once more, at temperature 0, with what was wrong.

    `call(prompt, model, **options)` is injected and returns (text, tokens in, tokens out). Every call is kept in `log` with its tokens and outcome.
    """

    def __init__(self, call, model: str, temperature: float = 0.2) -> None:  # noqa: ANN001
        self.call, self.model, self.temperature = call, model, temperature
        self.log: list[dict[str, Any]] = []

    def ask(self, step: str, check, **values: Any) -> Any:  # noqa: ANN001
        """The checked answer to PROMPTS[step]; `check` gives the result of parsed JSON or raises ValueError, KeyError or TypeError."""
        prompt, wrong = PROMPTS[step].format(**values), ""
        for attempt in range(2):
            options = {} if is_reasoning_model(self.model) else {"temperature": 0.0 if attempt else self.temperature}
            entry = {"step": step, "attempt": attempt, "model": self.model, "tokens_in": 0, "tokens_out": 0, "outcome": "error"}
            self.log.append(entry)
            try:
                text, entry["tokens_in"], entry["tokens_out"] = self.call(prompt + wrong, self.model, **options)
            except Exception as e:
                raise GatewayError(f"{step}: {e}") from e
            try:
                out = check(json.loads(text))
                entry["outcome"] = "ok"
                return out
            except (ValueError, KeyError, TypeError) as e:
                entry["outcome"] = "invalid"
                wrong = f"\nYour last answer was wrong: {e}"
        raise GatewayError(f"{step}: no valid answer")


class ModelBackend:
    """Plans by a language model behind a gateway."""

    def __init__(self, gateway: Gateway) -> None:
        self.gateway = gateway

    def intent(self, instruction: str) -> Intent:
        def check(raw: dict) -> Intent:
            return Intent(tuple(FieldSpec(f["name"], f.get("type", "string"), bool(f.get("required", False))) for f in raw["fields"]), raw.get("entity", "record"), raw.get("expected", "array"))

        return self.gateway.ask("intent", check, instruction=instruction)

    def plan(self, intent: Intent, compact: dict[str, Any], classes: list[str]) -> Plan:
        return self.gateway.ask("plan", lambda raw: Plan.from_json(json.dumps(raw)), strategies=STRATEGIES, fields=intent.schema().simpleString(), compact=json.dumps(compact)[:8000])

    def repair(self, intent: Intent, plan: Plan, report: dict[str, Any], compact: dict[str, Any], classes: list[str]) -> Plan | None:
        try:
            return self.gateway.ask("repair", lambda raw: Plan.from_json(json.dumps(raw)), fields=intent.schema().simpleString(), plan=plan.to_json(), report=json.dumps(report, default=str), compact=json.dumps(compact)[:8000])
        except GatewayError:
            return None


class RuleBackend:
    """Plans by rules alone. Its plans are made in tasks (`in_tasks`); a subclass that may be called there as well says so itself."""

    in_tasks = True

    def __init_subclass__(cls, **options: Any) -> None:
        super().__init_subclass__(**options)
        cls.in_tasks = cls.__dict__.get("in_tasks", False)

    def intent(self, instruction: str) -> Intent:
        """Fields of a list ("title, price and rating of each product"); "each", "all" and plurals ask for many records. The first field is required."""
        text = instruction.strip().lower().rstrip(".")
        head, _, tail = text.partition(" of ") if " of " in text else text.partition(" for ")
        head = re.sub(r"^(please )?(extract|get|find|list|collect|scrape|return)\s+(me )?(all |every |the |each )*", "", head)
        names = []
        for part in re.split(r",|;|\band\b|&", head):
            name = re.sub(r"[^a-z0-9]+", "_", re.sub(r"^(the|a|an|their|its) ", "", part.strip())).strip("_")
            if name and name[0].isalpha() and name not in names:
                names.append(name[:64])
        many = bool(re.search(r"\b(each|all|every|list)\b", text)) or tail.strip().endswith("s")
        fields = tuple(FieldSpec(n, kind_of(n), required=i == 0) for i, n in enumerate(names[:20] or ["title"]))
        return Intent(fields, entity=tail.strip() or "record", expected="array" if many else "object")

    def plan(self, intent: Intent, compact: dict[str, Any], classes: list[str]) -> Plan:
        names = [f.name for f in intent.fields]
        keys = {k.lower() for k in compact.get("payload_keys", [])}
        required = intent.required or names[:1]
        if all({n, n.replace("_", "")} & keys for n in required):
            return self._plan("structured_data", intent, [n for n in names if {n, n.replace("_", "")} & keys])
        if intent.expected == "array":
            for table in compact.get("tables") or []:
                heads = [h.lower() for h in table["headers"] if h]
                found = [n for n in names if any(h == field_term(n) or h in field_term(n) or field_term(n) in h for h in heads)]
                if found and all(n in found for n in required):
                    return self._plan("table_extraction", intent, found, table="table")
            sections = compact.get("candidate_sections") or []
            if sections:
                fields = tuple(FieldSelector(f.name, *self._selector(f, classes)) for f in intent.fields)
                return replace(self._plan("repeated_dom_selector", intent, names), container=sections[0]["selector"], fields=fields)
            return self._text(intent)
        if compact.get("page_type_hint") == "article" and any(n in ("title", "author", "date", "text", "content", "body", "summary") for n in names):
            return self._plan("article_extraction", intent, names)
        if compact.get("title") or compact.get("headings"):
            fields = tuple(FieldSelector(f.name, *self._selector(f, classes)) for f in intent.fields)
            return replace(self._plan("single_dom_selector", intent, names), fields=fields)
        return self._text(intent)

    def repair(self, intent: Intent, plan: Plan, report: dict[str, Any], compact: dict[str, Any], classes: list[str]) -> Plan | None:
        """The next best strategy: another section, then the text's patterns, then the facts."""
        sections = [s["selector"] for s in compact.get("candidate_sections") or []]
        if plan.container in sections and sections.index(plan.container) + 1 < len(sections):
            return replace(plan, container=sections[sections.index(plan.container) + 1], reason="next section")
        order = ["visible_text_regex", "semantic_extraction"]
        if plan.strategy == order[-1]:
            return None
        after = order[order.index(plan.strategy) + 1] if plan.strategy in order else order[0]
        return self._text(intent) if after == "visible_text_regex" else Plan("semantic_extraction", reason="facts")

    @staticmethod
    def _plan(strategy: str, intent: Intent, found: list[str], **more: Any) -> Plan:
        return Plan(strategy, confidence=len(found) / len(intent.fields), reason=f"{len(found)} of {len(intent.fields)} fields", **more)

    @staticmethod
    def _text(intent: Intent) -> Plan:
        patterns = tuple((f.name, _TEXT_PATTERNS[f.type]) for f in intent.fields if f.type in _TEXT_PATTERNS)
        return Plan("visible_text_regex", patterns=patterns, confidence=len(patterns) / len(intent.fields)) if patterns else Plan("manual_fallback_failed", reason="no strategy fits")

    @staticmethod
    def _selector(f: FieldSpec, classes: list[str]) -> tuple[str, str, str | None]:
        """selector, attribute and fallback by a class that speaks of the field, else by the customary element."""
        words = [w for w in f.name.split("_") if w]
        own = next((c for c in classes if any(w in c.lower() for w in words)), None)
        usual = {"url": ("a[href]", "href"), "date": ("time", "text")}.get(f.type)
        if usual:
            return (f".{own}[href]" if own and f.type == "url" else usual[0], usual[1], usual[0])
        if f.name in ("title", "name", "heading"):
            return (f".{own}" if own else "h1, h2, h3", "text", "h1, h2, h3")
        if f.name in ("image", "photo"):
            return ("img[src]", "src", None)
        if f.name in ("description", "summary"):
            return (f".{own}" if own else "p", "text", "p")
        return (f".{own}" if own else f"[class*='{words[0]}']", "text", None)


def ran(pages: DataFrame, plan: Plan, intent: Intent, max_records: int) -> tuple[DataFrame, DataFrame]:
    """The records and the report of one plan over pages that have `containers` (of the best section, or null)."""
    found = execute(pages, plan, intent, max_records)
    jobs = pages.select(F.col("page_id").alias("job_id"), "containers")
    return found, validate(jobs, found.select(F.col("page_id").alias("job_id"), "record"), intent)


def repaired(pages: DataFrame, plan: Plan, intent: Intent, backend: Backend, compact: dict[str, Any], classes: list[str], max_records: int = 100) -> tuple[DataFrame, DataFrame, list[Plan]]:
    """records, report (with attempts: repairs that a page's result took) and all plans tried on pages of one layout.

    A repair takes the pages that need one, and is kept where it scores higher. Reports are staged, as each step asks them twice.
    """
    if "containers" not in pages.columns:
        pages = pages.withColumn("containers", F.lit(None).cast("int"))
    records, report = ran(pages, plan, intent, max_records)
    records, report = staged(records), staged(report.withColumn("attempts", F.lit(0)))
    plans = [plan]
    while len(plans) <= MOST_REPAIRS:
        worst = report.where("needs_repair").orderBy("overall_score", "job_id").limit(1).collect()
        nxt = backend.repair(intent, plans[-1], worst[0].asDict(recursive=True), compact, classes) if worst else None
        if nxt is None:
            break
        weak = report.where("needs_repair").select("job_id", F.col("overall_score").alias("before"))
        again, scores = ran(pages.join(weak.select(F.col("job_id").alias("page_id")), "page_id", "left_semi"), nxt, intent, max_records)
        better = staged(scores.join(weak, "job_id").where("overall_score > before").drop("before").withColumn("attempts", F.lit(len(plans))))
        ids = better.select(F.col("job_id").alias("page_id"))
        records = staged(records.join(ids, "page_id", "left_anti").unionByName(again.join(ids, "page_id", "left_semi")))
        report = staged(report.join(better.select("job_id"), "job_id", "left_anti").unionByName(better))
        plans.append(nxt)
    return records, report, plans
