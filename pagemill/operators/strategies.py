"""Extraction strategies: pages and a plan to records.

Each takes `pages` (page_id, url, and what it reads: nodes, html or embedded) and gives records as
(page_id, row_idx, record map<string,string>, hits, misses): what the plan's fields found and missed in that row. Records
without any value are left out. All stay within the row until records are exploded; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.embedded import items_of
from pagemill.functions import normalize as norm
from pagemill.functions.text import field_term, key_variants, let, or_null
from pagemill.functions.urls import join_url
from pagemill.plans.model import ALL_RECORDS, MOST_PATTERNS, FieldSelector, Intent, Plan

from . import css, density, dom
from .dom import NAV
from .patterns import first_match

NO_RECORDS = "page_id long, row_idx int, record map<string,string>, hits array<string>, misses array<string>"
Strategy = Callable[[DataFrame, Plan, Intent, int], DataFrame]
STRATEGY: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Registers a strategy under a plan's name for it."""
    def put(f: Strategy) -> Strategy:
        STRATEGY[name] = f
        return f

    return put


def _read(nodes: Column, n: Column, attribute: str, base: Column) -> Column:
    """A node's text or attribute; links are made absolute."""
    if attribute == "text":
        return dom.text_of(nodes, n)
    value = dom.attribute(n, attribute)
    return join_url(base, value) if attribute in ("href", "src") else value


def _field(nodes: Column, s: FieldSelector | None, kind: str, base: Column) -> Column:
    """A field's value within nodes: by its selector, else by its fallback; null is a miss."""
    if s is None:
        return F.lit(None).cast("string")
    read = lambda sel: _read(nodes, css.select_first(nodes, sel) if sel else dom.first(nodes), s.attribute, base)
    value = or_null(read(s.selector))
    if s.fallback:
        value = F.coalesce(value, or_null(read(s.fallback)))
    return _normal(value, kind, base)


def _normal(value: Column, kind: str, base: Column) -> Column:
    """A value normalised by its type, but for dates: those are left to `_rows`, where they are columns of their own."""
    return value if kind == "date" else norm.normalize(value, kind, base)


def _rows(rows: DataFrame, intent: Intent, values: dict[str, Column], most: int) -> DataFrame:
    """Records of rows (page_id, row_idx) from the columns of their fields. Those without a value go where they are made: a filter behind would have all of it worked out twice."""
    dates = [f.name for f in intent.fields if f.type == "date"]
    if dates:
        rows = rows.withColumns({f"date of {n}": values[n] for n in dates})
        values = values | {n: norm.date(F.col(f"date of {n}")) for n in dates}
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in values.items()))
    there = lambda p: F.coalesce(p["value"], F.lit("")) != ""

    def record(ps: Column) -> Column:
        own = F.filter(ps, there)
        gone = F.filter(ps, lambda p: ~there(p))
        return F.struct(F.map_from_entries(own).alias("record"), F.transform(own, lambda p: p["key"]).alias("hits"), F.transform(gone, lambda p: p["key"]).alias("misses"))

    full = F.filter(F.array(let(pairs, record)), lambda r: F.size(r["record"]) > 0)
    out = rows.select("page_id", "row_idx", F.explode(full).alias("r"))
    return out.select("page_id", "row_idx", "r.record", "r.hits", "r.misses").where(F.col("row_idx") < most)


@strategy("single_dom_selector")
def single(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    """One record of a page."""
    nodes, base = F.col("nodes"), F.col("url")
    return _rows(pages.withColumn("row_idx", F.lit(0)), intent, {f.name: _field(nodes, plan.selector_of(f.name), f.type, base) for f in intent.fields}, most)


@strategy("repeated_dom_selector")
def repeated(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    """A record of each container. An empty or over-long container selector gives none."""
    try:
        found = css.select_all(F.col("nodes"), plan.container or "", most)
    except css.InvalidSelectorError:
        return pages.sparkSession.createDataFrame([], NO_RECORDS)
    parts = F.transform(found, lambda n: dom.subtree(F.col("nodes"), n))
    rows = pages.select("page_id", "url", F.posexplode(parts).alias("row_idx", "nodes"))
    inner = F.slice(F.col("nodes"), F.lit(2), F.size("nodes"))
    rows = rows.withColumn("inner", inner)
    values = {}
    for f in intent.fields:
        s = plan.selector_of(f.name)
        values[f.name] = _field(F.col("inner") if s and s.selector else F.col("nodes"), s, f.type, F.col("url"))
    return _rows(rows, intent, values, most)


@strategy("table_extraction")
def table(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    """Rows of the first table that the selector yields. A header is a field's by its name, else if either holds the other; empty headers are no one's."""
    nodes = F.col("nodes")
    row = lambda tr: F.transform(dom.with_tag(dom.below(nodes, tr), "td", "th"), lambda c: F.struct(c["tag"].alias("tag"), dom.text_of(nodes, c).alias("text")))
    cells = dom.let(css.select_first(nodes, plan.table or plan.container or "table"), lambda t: F.transform(dom.with_tag(dom.below(nodes, t), "tr"), row))
    rows = pages.select("page_id", "url", F.filter(cells, lambda r: F.size(r) > 0).alias("cells")).where("size(cells) > 0")
    head = F.transform(F.get("cells", F.lit(0)), lambda c: F.lower(c["text"]))
    has_th = F.exists(F.get("cells", F.lit(0)), lambda c: c["tag"] == "th")
    body = F.when(has_th, F.slice("cells", F.lit(2), F.size("cells"))).otherwise(F.col("cells"))
    rows = rows.select("page_id", "url", head.alias("head"), F.posexplode(body).alias("row_idx", "row"))

    def cell(name: str) -> Column:
        term = field_term(name).lower()
        exact = F.array_position("head", term)
        near = F.array_position(F.transform("head", lambda h: (h != "") & (h.contains(term) | F.lit(term).contains(h))), True)
        at = F.when(exact > 0, exact).otherwise(near)
        return F.when(at > 0, F.get("row", (at - 1).cast("int"))["text"])

    return _rows(rows, intent, {f.name: _normal(cell(f.name), f.type, F.col("url")) for f in intent.fields}, most)


def article(nodes: Column) -> dict[str, Column]:
    """title, author, date, description and text of an article: its heading, its metadata or byline, and the paragraphs of <article> or <main> outside navigation and ads; where a page has neither, its densest text (`density.main_text`), else all its paragraphs."""
    name = lambda *keys: dom.attribute(dom.first(F.filter(nodes, lambda n: (n["tag"] == "meta") & F.coalesce(F.element_at(n["attrs"], F.lit("name")), F.element_at(n["attrs"], F.lit("property")), F.lit("")).isin(*keys))), "content")
    out = F.filter(nodes, lambda n: n["tag"].isin(*NAV) | F.array_contains(F.split(F.coalesce(F.element_at(n["attrs"], F.lit("class")), F.lit("")), r"\s+"), "ad"))
    within = lambda around, root: F.filter(dom.below(nodes, root), lambda n: (n["tag"] == "p") & ~F.exists(around, lambda o: dom.inside(n, o)))
    root = F.coalesce(*(dom.first(dom.with_tag(nodes, t)) for t in ("article", "main", "body")))
    kept = dom.let(root, lambda r: dom.let(out, lambda around: within(around, r)))
    text = F.array_join(F.filter(F.transform(kept, lambda n: dom.text_of(nodes, n)), lambda t: t != ""), "\n")
    marked = F.exists(nodes, lambda n: n["tag"].isin("article", "main"))
    text = F.when(marked, text).otherwise(F.coalesce(or_null(density.main_text(nodes)), text))
    when = F.coalesce(name("article:published_time", "date"), dom.attribute(dom.first(dom.with_tag(nodes, "time")), "datetime"))
    return {
        "title": F.coalesce(or_null(dom.text_of(nodes, dom.first(dom.with_tag(nodes, "h1")))), or_null(dom.text_of(nodes, dom.first(dom.with_tag(nodes, "title"))))),
        "author": F.coalesce(or_null(name("author", "article:author")), or_null(density.byline(nodes))),
        "date": or_null(when),
        "description": or_null(name("description", "og:description")),
        "text": or_null(text),
    }


#: What fields of an article may be called.
ARTICLE_ALIAS = {"title": "title", "author": "author", "date": "date", "publish_date": "date", "summary": "description", "description": "description", "text": "text", "content": "text", "body": "text", "url": "url"}


@strategy("article_extraction")
def articles(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    """One record of a page's article."""
    own = article(F.col("nodes")) | {"url": F.col("url")}
    values = {}
    for f in intent.fields:
        source = ARTICLE_ALIAS.get(f.name)
        values[f.name] = _normal(own[source], f.type, F.col("url")) if source and source != "text" else own["text"] if source else F.lit(None).cast("string")
    return _rows(pages.withColumn("row_idx", F.lit(0)), intent, values, most)


@strategy("visible_text_regex")
def text_patterns(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    """One record of what named patterns find in a page's visible text (a `text` column, if the pages have one)."""
    from .page import visible_text

    rows = pages if "text" in pages.columns else pages.withColumn("text", visible_text(F.col("nodes")))
    patterns = dict(plan.patterns[:MOST_PATTERNS])
    values = {f.name: _normal(first_match(F.col("text"), patterns[f.name]), f.type, F.col("url")) if f.name in patterns else F.lit(None).cast("string") for f in intent.fields}
    return _rows(rows.withColumn("row_idx", F.lit(0)), intent, values, most)


def json_field(item: Column, name: str) -> Column:
    """A field of a JSON object under the first of its spellings that is a key; of a nested object its name, @id or url, else its text."""
    keys = F.coalesce(F.json_object_keys(item), F.array().cast("array<string>"))
    value = F.lit(None).cast("string")
    for key in reversed(key_variants(name)):
        value = F.when(F.array_contains(keys, key), F.get_json_object(item, f"$['{key}']")).otherwise(value)
    inner = lambda k: F.get_json_object(value, f"$['{k}']")
    return F.when(value.startswith("{"), F.coalesce(inner("name"), inner("@id"), inner("url"), value)).otherwise(value)


@strategy("structured_data")
def structured(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    """A record of each object in a page's payloads."""
    items = F.flatten(F.transform(F.col("embedded.payloads"), lambda p: items_of(p["json"])))
    rows = pages.select("page_id", "url", F.posexplode(F.slice(items, 1, most)).alias("row_idx", "item"))
    return _rows(rows, intent, {f.name: _normal(json_field(F.col("item"), f.name), f.type, F.col("url")) for f in intent.fields}, most)


@strategy("manual_fallback_failed")
def nothing(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    return pages.sparkSession.createDataFrame([], NO_RECORDS)


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


@strategy("semantic_extraction")
def semantic(pages: DataFrame, plan: Plan, intent: Intent, most: int) -> DataFrame:
    """One record of a page's facts: for each field the pair whose label shares most words with its name, else title and url by name. Needs `facts`, or of them what the fields take: key_value_pairs, title, meta_description."""
    fact = lambda name: F.col(name) if name in pages.columns else F.col(f"facts.{name}")
    said = F.transform(fact("key_value_pairs"), lambda p: F.struct(F.array_distinct(tokens_of(p["label"])).alias("words"), p["value"].alias("value")))
    known = {"title": "title", "name": "title", "description": "meta_description"}

    def value(name: str) -> Column:
        words = {w for w in name.split("_") if w}
        shared = lambda p: sum((F.array_contains(p["words"], w).cast("int") for w in sorted(words)), F.lit(0))
        score = lambda p: let(shared(p), lambda n: n / F.greatest(F.size(p["words"]) + len(words) - n, F.lit(1)))
        scored = F.transform("said", lambda p, i: F.struct(score(p).alias("s"), (-i).alias("o"), p["value"].alias("v")))
        best = let(F.array_max(scored), lambda b: F.when(b["s"] > 0, b["v"]))
        own = fact(known[name]) if name in known else F.col("url") if name == "url" else F.lit(None).cast("string")
        return F.coalesce(best, own)

    rows = pages.withColumns({"row_idx": F.lit(0), "said": said})
    return _rows(rows, intent, {f.name: _normal(value(f.name), f.type, F.col("url")) for f in intent.fields}, most)


def semantic_by(pages: DataFrame, intent: Intent, extract: Callable[[str, Intent, int], list[dict]], most: int = 100) -> DataFrame:
    """Records that an injected extractor reads from a page's facts (pages need `facts`): extract(facts text, intent, most) -> a list of objects.

    It runs in the tasks, once more where it raises; after that the page has no records. Fields are normalised by their
    type, lists are joined, others are left out, and records without any value as well.
    """
    names = [f.name for f in intent.fields]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for page_id, url, text in zip(pdf["page_id"], pdf["url"], pdf["text"], strict=True):
                found: list[dict] = []
                for _ in range(2):
                    try:
                        found = list(extract(text, intent, most))[:most]
                        break
                    except Exception:  # noqa: BLE001, S112
                        continue
                for i, record in enumerate(found):
                    values = {n: "; ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for n in names if (v := record.get(n)) is not None}
                    rows.append((page_id, url, i, values))
            yield pd.DataFrame(rows, columns=["page_id", "url", "row_idx", "raw"])

    from .page import facts_text

    found = pages.select("page_id", "url", facts_text(F.col("facts")).alias("text")).mapInPandas(run, "page_id long, url string, row_idx int, raw map<string,string>")
    return _rows(found, intent, {f.name: _normal(F.element_at("raw", F.lit(f.name)), f.type, F.col("url")) for f in intent.fields}, most)


def execute(pages: DataFrame, plan: Plan, intent: Intent, max_records: int = ALL_RECORDS) -> DataFrame:
    """The records that a plan finds, at most so many of a page."""
    return STRATEGY[plan.strategy](pages, plan, intent, max_records)


def field_stats(records: DataFrame) -> DataFrame:
    """(page_id, field, hits, misses, errors). Columns do not raise: what cannot be read is a miss, and errors are 0."""
    rows = records.select("page_id", F.explode(F.concat(F.transform("hits", lambda f: F.struct(f.alias("field"), F.lit(1).alias("hit"))), F.transform("misses", lambda f: F.struct(f.alias("field"), F.lit(0).alias("hit"))))).alias("x"))
    return rows.groupBy("page_id", "x.field").agg(F.sum("x.hit").alias("hits"), F.sum(1 - F.col("x.hit")).alias("misses"), F.lit(0).cast("long").alias("errors"))
