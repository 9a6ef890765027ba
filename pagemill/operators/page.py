"""What a page says about itself: title, headings, links, pairs, tables, embedded data, text and type. Columns over nodes and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import built_once, collapse, field_term
from pagemill.functions.urls import join_url

from . import dom
from .sections import NO_SECTIONS, sections_of

#: Marks of calendar links, and the order in which blocks of text are taken.
CALENDAR = r"(?i)\.ics|calendar|ical|icalendarfrom=|ical="
BLOCK_TAGS = ["h1", "h2", "h3", "h4", "p", "li", "section", "article", "blockquote"]


def _cut(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def _distinct_by(array: Column, key, most: int) -> Column:  # noqa: ANN001
    """The first element of each key, in order; at most so many."""
    step = lambda held, x: F.when((F.size(held) >= most) | F.exists(held, lambda y: key(y) == key(x)), held).otherwise(F.concat(held, F.array(x)))
    return dom.let(array, lambda every: F.aggregate(every, F.filter(every, lambda x: F.lit(False)), step))


def title(nodes: Column) -> Column:
    return _cut(dom.text_of(nodes, dom.first(dom.with_tag(nodes, "title"))), 300)


def meta_description(nodes: Column) -> Column:
    meta = F.filter(nodes, lambda n: (n["tag"] == "meta") & (F.element_at(n["attrs"], F.lit("name")) == "description"))
    return _cut(dom.attribute(dom.first(meta), "content"), 500)


def _headings(nodes: Column, most: int, longest: int, distinct: bool) -> Column:
    by_level = F.concat(*(F.transform(dom.with_tag(nodes, h), lambda n: _cut(dom.text_of(nodes, n), longest)) for h in ("h1", "h2", "h3")))
    kept = F.filter(by_level, lambda t: t != "")
    return F.slice(F.array_distinct(kept) if distinct else kept, 1, most)


def headings(nodes: Column) -> Column:
    return _headings(nodes, 30, 120, False)


def distinct_headings(nodes: Column) -> Column:
    return _headings(nodes, 25, 150, True)


def _hrefs(nodes: Column) -> Column:
    href = lambda n: F.trim(F.element_at(n["attrs"], F.lit("href")))
    return F.filter(nodes, lambda n: (n["tag"] == "a") & (F.coalesce(href(n), F.lit("")) != "") & ~href(n).startswith("#") & ~F.lower(href(n)).startswith("javascript:"))


def links(nodes: Column, base: Column) -> Column:
    """Links of the content, not of navigation; at most 20."""
    content = F.filter(_hrefs(nodes), lambda n: ~n["nav"])
    return F.transform(F.slice(content, 1, 20), lambda n: F.struct(_cut(dom.text_of(nodes, n), 120).alias("text"), join_url(base, dom.attribute(n, "href")).alias("href")))


def anchors(nodes: Column, base: Column) -> Column:
    """All links, distinct in text and target; at most 80."""
    pair = F.transform(_hrefs(nodes), lambda n: F.concat(_cut(dom.text_of(nodes, n, " "), 140), F.lit("\0"), F.coalesce(join_url(base, dom.attribute(n, "href")), F.lit(""))))  # strings are told apart by their hash, structs one by one
    return F.transform(F.slice(F.array_distinct(pair), 1, 80), lambda p: F.struct(F.substring_index(p, "\0", 1).alias("text"), F.substring_index(p, "\0", -1).alias("href")))


def calendar_urls(anchor_list: Column) -> Column:
    return F.slice(F.filter(F.transform(anchor_list, lambda a: a["href"]), lambda h: h.rlike(CALENDAR)), 1, 5)


def _pair(label: Column, value: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"))


def _full(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: (F.coalesce(p["label"], F.lit("")) != "") & (F.coalesce(p["value"], F.lit("")) != ""))


def list_pairs(nodes: Column) -> Column:
    """dt and dd of each dl, one to one in order."""
    text = lambda n, most: _cut(dom.text_of(nodes, n, " "), most)

    def of(dl: Column) -> Column:
        own = dom.below(nodes, dl)
        both = lambda dt, dd: F.transform(F.slice(dt, F.lit(1), F.least(F.size(dt), F.size(dd))), lambda n, i: _pair(text(n, dom.LONGEST_LABEL), text(F.get(dd, i), dom.LONGEST_VALUE)))
        return dom.let(dom.with_tag(own, "dt"), lambda dt: dom.let(dom.with_tag(own, "dd"), lambda dd: both(dt, dd)))

    return _full(F.flatten(F.transform(dom.with_tag(nodes, "dl"), of)))


def row_pairs(nodes: Column) -> Column:
    """Table rows of exactly two cells."""
    cells = lambda tr: dom.with_tag(dom.below(nodes, tr), "td", "th")
    rows = F.filter(F.transform(dom.with_tag(nodes, "tr"), cells), lambda c: F.size(c) == 2)
    return _full(F.transform(rows, lambda c: _pair(_cut(dom.text_of(nodes, F.get(c, F.lit(0)), " "), dom.LONGEST_LABEL), _cut(dom.text_of(nodes, F.get(c, F.lit(1)), " "), dom.LONGEST_VALUE))))


def label_pairs(nodes: Column) -> Column:
    """Elements whose class speaks of a label or key, with the first of five next siblings that has text."""
    labels = F.filter(nodes, lambda n: dom.is_element(n) & F.coalesce(F.element_at(n["attrs"], F.lit("class")), F.lit("")).rlike(dom.LABEL_CLASS))

    def of(n: Column) -> Column:
        nearer = lambda held: dom.let(dom.node_at(nodes, F.get(held, F.size(held) - 1)), lambda s: F.when(s["next"] < 0, held).otherwise(F.concat(held, F.array(s["next"]))))
        after = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(dom.NEXT_SIBLINGS)), F.array(n["nid"]), lambda held, _: nearer(held)), 2, dom.NEXT_SIBLINGS)
        values = F.filter(F.transform(after, lambda s: _cut(dom.text_of(nodes, dom.node_at(nodes, s), " "), dom.LONGEST_NEXT)), lambda v: v != "")
        return _pair(dom.text_of(nodes, n, " "), dom.first(values))

    return F.filter(_full(F.transform(labels, of)), _short)


def _short(pair: Column) -> Column:
    return F.length(pair["label"]) <= 80


def _chosen(plain: Column, by_class: Column) -> Column:
    """Pairs of lists, then of rows, then (where those are under 30) of labels; the first of each label; at most 40."""
    every = dom.let(plain, lambda own: F.when(F.size(own) < 30, F.concat(own, by_class)).otherwise(own))
    return _distinct_by(every, lambda p: F.lower(p["label"]), 40)


def key_values(nodes: Column) -> Column:
    """The pairs of a page's nodes (see `_chosen`)."""
    return _chosen(F.concat(list_pairs(nodes), row_pairs(nodes)), label_pairs(nodes))


def pairs_said(pairs: Column) -> Column:
    """What `key_values` gives, of what the parse says may be a pair (`dom.parse_pages` with `pairs`): no expression over nodes."""
    own = lambda keep: F.transform(F.filter(pairs, keep), lambda p: _pair(p["label"], p["value"]))
    return _chosen(own(lambda p: ~p["by_class"]), own(lambda p: p["by_class"] & _short(p)))


def text_blocks(nodes: Column) -> Column:
    blocks = F.concat(*(F.transform(dom.with_tag(nodes, t), lambda n: dom.text_of(nodes, n, " ")) for t in BLOCK_TAGS))
    return F.slice(F.array_distinct(F.filter(blocks, lambda t: F.length(t).between(8, 600))), 1, 40)


def visible_text(nodes: Column) -> Column:
    whole = F.array_join(F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: n["text"]), "")
    return dom.let(dom.first(dom.with_tag(nodes, "body")), lambda body: F.when(body.isNotNull(), dom.text_of(nodes, body)).otherwise(collapse(whole)))


def tables(nodes: Column) -> Column:
    """The first five tables: a selector, rows, columns, headers, two sample rows. A table without th has its first row as headers and as data."""

    def of(t: Column, i: Column) -> Column:
        rows = F.transform(dom.with_tag(dom.below(nodes, t), "tr"), lambda tr: dom.with_tag(dom.below(nodes, tr), "td", "th"))
        has_th = F.exists(F.coalesce(dom.first(rows), F.filter(nodes, lambda n: F.lit(False))), lambda c: c["tag"] == "th")
        cells = F.transform(rows, lambda r: F.transform(r, lambda c: _cut(dom.text_of(nodes, c), 100)))
        head = F.slice(F.coalesce(dom.first(cells), F.array().cast("array<string>")), 1, 30)
        body = F.when(has_th, F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1)))).otherwise(cells)
        return F.struct(
            F.concat(F.lit("table:nth("), (i + 1).cast("string"), F.lit(")")).alias("selector"),
            F.size(body).alias("row_count"),
            F.coalesce(F.array_max(F.transform(F.slice(body, 1, 5), lambda r: F.size(r))), F.lit(0)).alias("col_count"),
            head.alias("headers"),
            F.slice(body, 1, 2).alias("sample_rows"),
        )

    return F.transform(F.slice(dom.with_tag(nodes, "table"), 1, 5), of)


def classify(nodes: Column, embedded: Column, sections: Column, table_list: Column, visible_length: Column) -> Column:
    """The kind of page, by the first rule that holds."""
    types = F.transform(embedded["json_ld_types"], lambda t: F.lower(t))
    micro = F.transform(embedded["microdata_types"], lambda t: F.lower(t))
    either = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names))) | F.arrays_overlap(micro, F.array(*map(F.lit, names)))
    top = F.coalesce(dom.first(sections)["count"], F.lit(0))
    return (
        F.when(F.arrays_overlap(types, F.array(F.lit("article"), F.lit("newsarticle"))) | F.array_contains(micro, "article"), "article")
        .when(either("product"), F.when(top >= 3, "product_listing").otherwise("product_detail"))
        .when(either("jobposting"), "job_listing")
        .when(F.coalesce(dom.first(table_list)["row_count"], F.lit(0)) > 5, "table_page")
        .when(top >= 5, "directory_listing")
        .when(top >= 3, "search_results")
        .when((visible_length > 3000) & (top == 0), "article")
        .otherwise("generic_content")
    )


@built_once
def _analysis() -> tuple[dict[str, Column], Column]:
    nodes, base = F.col("nodes"), F.col("url")
    parts = {"sections": F.coalesce(sections_of(nodes), F.array().cast(NO_SECTIONS)), "page_tables": tables(nodes), "visible_length": F.length(visible_text(nodes))}
    kind = classify(nodes, F.col("embedded"), F.col("sections"), F.col("page_tables"), F.col("visible_length"))
    ratio = F.col("visible_length") / F.greatest(F.col("markup_length"), F.lit(1))
    compact = F.struct(
        title(nodes).alias("title"), meta_description(nodes).alias("meta_description"), headings(nodes).alias("headings"),
        F.col("visible_length").alias("visible_text_length"), ratio.alias("text_to_markup_ratio"), F.col("sections").alias("candidate_sections"),
        F.col("page_tables").alias("tables"), links(nodes, base).alias("links"), kind.alias("page_type_hint"),
    )
    return parts, compact


def analyze(pages: DataFrame) -> DataFrame:
    """`pages` (nodes, embedded, url, markup_length) with compact: what a planner is shown of a page. All is within the row; nothing is shuffled. Of long pages text_length is known (see `dom.parse_pages`)."""
    parts, compact = _analysis()
    if "text_length" in pages.columns:
        parts = parts | {"visible_length": F.coalesce("text_length", parts["visible_length"])}
    return pages.withColumns(parts).withColumn("compact", compact).drop("sections", "page_tables", "visible_length")


def facts(nodes: Column, base: Column, embedded: Column) -> Column:
    """The facts bundle of a page: what it says, without its markup."""
    return dom.let(anchors(nodes, base), lambda every: _bundle(nodes, base, embedded, every))


def _bundle(nodes: Column, base: Column, embedded: Column, every: Column) -> Column:
    return F.struct(
        base.alias("url"), title(nodes).alias("title"), meta_description(nodes).alias("meta_description"), _cut(F.to_json(embedded), 6000).alias("structured_data_compact"),
        every.alias("anchors"), key_values(nodes).alias("key_value_pairs"), text_blocks(nodes).alias("text_blocks"), distinct_headings(nodes).alias("headings"), calendar_urls(every).alias("calendar_urls"),
    )


def facts_text(bundle: Column, most: int = 14_000) -> Column:
    """A bundle as sections of text, cut with a mark."""
    part = lambda name, body: F.when(body != "", F.concat(F.lit(f"## {name}\n"), body))
    lines = lambda array: F.array_join(F.transform(array, lambda x: F.concat(F.lit("- "), x)), "\n")
    whole = F.concat_ws(
        "\n\n",
        part("URL", F.coalesce(bundle["url"], F.lit(""))), part("Title", F.coalesce(bundle["title"], F.lit(""))), part("Description", F.coalesce(bundle["meta_description"], F.lit(""))),
        part("Structured data", F.coalesce(bundle["structured_data_compact"], F.lit(""))), part("Headings", lines(bundle["headings"])),
        part("Pairs", lines(F.transform(bundle["key_value_pairs"], lambda p: F.concat_ws(": ", p["label"], p["value"])))),
        part("Links", lines(F.transform(bundle["anchors"], lambda a: F.concat_ws(" -> ", a["text"], a["href"])))), part("Calendars", lines(bundle["calendar_urls"])), part("Text", lines(bundle["text_blocks"])),
    )
    return F.when(F.length(whole) > most, F.concat(_cut(whole, most), F.lit("\n[truncated]"))).otherwise(whole)


def compact_text(compact: Column, most: int = 8_000) -> Column:
    """A compact page as JSON of at most `most` characters: lists get shorter until it fits, and it stays valid JSON."""
    def trimmed(n: int) -> Column:
        short = compact
        for name in ("headings", "links", "tables", "candidate_sections"):
            short = short.withField(name, F.slice(compact[name], 1, n))
        return F.to_json(short)

    sizes = [30, 8, 3, 1]
    tries = [F.when(F.length(trimmed(n)) <= most, trimmed(n)) for n in sizes]
    return F.coalesce(*tries, F.to_json(F.struct(compact["title"].alias("title"), compact["page_type_hint"].alias("page_type_hint"))))


def static_is_enough(compact: Column, embedded: Column, expected: str, required: list[str]) -> Column:
    """Whether a page needs no rendering for an intent: enough text and, for arrays, something repeated that speaks of a required field."""
    enough = (compact["visible_text_length"] >= 1000) & ~((compact["text_to_markup_ratio"] < 0.05) & embedded["next_data_present"])
    if expected != "array":
        return enough
    samples = F.flatten(F.transform(compact["candidate_sections"], lambda s: s["sample_texts"]))
    said = F.lower(F.concat_ws(" ", compact["headings"], samples))
    terms = [said.contains(field_term(name).lower()) for name in required]
    speaks = F.size(embedded["json_ld_types"]) > 0
    for term in terms:
        speaks = speaks | term
    return enough & ((F.size(compact["candidate_sections"]) > 0) | (F.size(compact["tables"]) > 0)) & speaks
