"""Plans as data against the strategies that are written for one plan; and that jobs do not follow the number of layouts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill import api
from pagemill.functions.embedded import embedded
from pagemill.operators import dom, interpreter, patterns, strategies, templates
from pagemill.plans.backend import RuleBackend
from pagemill.plans.model import FieldSelector, FieldSpec, Intent, Options, Plan
from pagemill.streaming import step

PAGE = """<html><head><title>T</title></head><body><nav><a href="/n">nav</a></nav><div id=main class="grid wide">
<article class="card odd" data-x="ab-c"><h2 class="title">One &amp; only</h2><span class="price">$1.50</span><a class=link href="../p/1" rel="x y">go</a><p>first <b>bold</b></p></article>
<article class="card"><h2 class="title">Two</h2><span class="price">no price</span><a class=link href="">go</a><time datetime="2024-05-06">May</time></article>
<article class="card last"><h2></h2><span class="price">€ 3,20</span><p>mail a.b@c.org<p>second</p></article></div>
<table><tr><th>Name<th>Unit Price<th>Released<tr><td>A<td>3<td>5 May 2024<tr><td>B<tr></table><table><tr><td>name<td>price<tr><td>C<td>9</table><p>é  x</p></body></html>"""
OTHER = "<p>call +1 555 123 4567 or x@y.org</p><ul><li>a<li>b</ul>"
INTENT = Intent((FieldSpec("title", "string", True), FieldSpec("price", "currency"), FieldSpec("url", "url"), FieldSpec("released", "date"), FieldSpec("name")))
SELECTORS = ["article", ".card", "article.card.odd", "#main > article", "article + article", "article ~ article", "div article h2", "[data-x^='ab']", "[data-x|=ab]", "[rel~=y]", "a[href$='1']", "a[href*='']", "article:first-child", "article:nth-child(2n+1)", "article:last-of-type", "article:not(.odd)", "article:contains('go'), h2", "b:only-child", "p:nth-last-of-type(1)", "h2:hover, li", "*", ">", "body p", "article, article", "nope"]


def parsed(spark, *html):
    rows = spark.createDataFrame([(i, "https://x.example.com/a/list.html", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    return dom.parse_pages(rows.withColumns({"markup_length": F.length("html"), "embedded": embedded(F.col("html"))}))


def plans():
    f = lambda **s: tuple(FieldSelector(n, *(v if isinstance(v, tuple) else (v,))) for n, v in s.items())
    fields = f(title="h2", price=(".price", "text", "b"), url=("a", "href", "nav a"), released=("time", "datetime"), name=("", "data-x"))
    out = [Plan("repeated_dom_selector", container=s, fields=fields) for s in SELECTORS] + [Plan("repeated_dom_selector", container=c, fields=fields) for c in (None, "", "a" * 501)]
    out += [Plan("single_dom_selector", fields=f(title=(s, "text"), url=("a.link", "href"), name=("", "class"))) for s in SELECTORS[:12]] + [Plan("single_dom_selector", fields=f(title="", name=("x" * 501, "text", "h2")))]
    out += [Plan("table_extraction", table=t) for t in (None, "table", "table:nth-of-type(2)", "nope", "ul", "b" * 501)]
    out += [Plan("visible_text_regex", patterns=(("price", r"([$€]\s?\d+(?:[.,]\d+)?)"), ("name", r"[a-z.]+@[a-z]+\.org"), ("title", p))) for p in ("(bold)", "(", "(?P<x>TWO)", "z+", "(?:a|b)+l")]
    return out + [Plan("article_extraction"), Plan("structured_data"), Plan("manual_fallback_failed")]


def test_interpreter_equals_the_strategies(spark):
    every = plans()
    pages = parsed(spark, *[h for _ in every for h in (PAGE, OTHER)]).withColumn("plan", F.element_at(F.array(*(F.lit(p.to_json()) for p in every)), (F.floor(F.col("page_id") / 2) + 1).cast("int"))).cache()
    records, notes = interpreter.run_plans(pages, INTENT, 1000)
    got = {}
    for r in records.select("page_id", "row_idx", "record", "hits", "misses").collect():
        got.setdefault(r.page_id, []).append((r.row_idx, r.record, r.hits, r.misses))
    two = parsed(spark, PAGE, OTHER).cache()
    for k, plan in enumerate(every):
        want = {}
        for r in strategies.execute(two, plan, INTENT).collect():
            want.setdefault(r.page_id, []).append((r.row_idx, r.record, r.hits, r.misses))
        for i in (0, 1):
            assert sorted(got.get(2 * k + i, []), key=lambda x: x[0]) == sorted(want.get(i, []), key=lambda x: x[0]), (plan, i)
    said = {r.page_id: r.notes for r in notes.collect()}
    assert said[2 * SELECTORS.index("nope")] == ["container: nothing matches"]
    assert any("no pattern" in n for ns in said.values() for n in ns) and any("selector of over 500" in n for ns in said.values() for n in ns)


def test_a_plan_that_cannot_be_read_is_a_note(spark):
    pages = parsed(spark, PAGE, PAGE).withColumn("plan", F.lit('{"strategy": "single_dom_selector", "fields": [{"nme": 1}]}'))
    records, notes = interpreter.run_plans(pages, INTENT, 10)
    assert records.count() == 0 and all(r.notes[0].startswith("plan: ") for r in notes.collect())


@pytest.mark.parametrize(("pattern", "bounded"), [(r"(\d{4}-\d{2}-\d{2})", True), ("x(.*?)y", True), ("(ab)+", True), ("(a+)+$", False), ("(a|aa)+$", False), ("(.*a){20}", False), (r"(a)\1", False), ("(?=a)b", False), ("(", False), ("(?:a{1,3}){2,9}", False)])
def test_patterns_are_told_apart(pattern, bounded):
    assert patterns.is_bounded(pattern) is bounded


def test_every_pattern_ends(spark):
    text = "a" * 100_000 + "b"
    df = spark.createDataFrame([(text,), ("xaa",), (None,)], "t string")
    for pattern in ("(a+)+$", "(a|aa)+$", "(.*a){20}c"):
        began = time.time()
        rows = df.select(patterns.first_match(F.col("t"), pattern).alias("m"), patterns.match_note(F.col("t"), pattern).alias("n")).collect()
        assert time.time() - began < 20
        assert rows[0].m is None and rows[2].m is None
        assert rows[0].n == "stopped after its time"
    assert patterns.timed_match("x12", r"\d(\d)") == ("2", None) and patterns.timed_match("x", "(")[1].startswith("no pattern")


def layouts(spark, n, html):
    return spark.createDataFrame([(i, f"https://shop{i}.com/list/{i}", html(i)) for i in range(n)], "page_id long, url string, html string")


def cards(i):
    own = "".join(f'<article class="c{i}"><h2 class="title{i}">Thing {i} {k}</h2><span class="price">${k}.50</span><a href="/{k}">more</a></article>' for k in range(3))
    return f"<html><body><div>{own}</div></body></html>" if i % 10 else "<p>nothing</p>"


def jobs_of(spark, run):
    group = f"g{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_jobs_do_not_follow_the_layouts(spark):
    engine = api.Engine(spark)
    ask = "Extract the title, price and url of all products"
    few, _ = jobs_of(spark, lambda: engine.extract(layouts(spark, 20, cards), ask, semantic=False))
    many, result = jobs_of(spark, lambda: engine.extract(layouts(spark, 1000, cards), ask, semantic=False))
    assert many <= few + 3  # what Spark adds itself
    rows = result.records.where("page_id % 10 > 0").collect()
    assert len(rows) == 900 * 3 and {r.record["title"] for r in rows if r.page_id == 7} == {f"Thing 7 {k}" for k in range(3)}
    assert result.plans.count() == 1000 and result.plans.select("plan").distinct().count() > 800


def test_driver_backends_plan_every_layout(spark):
    seen = []

    class Driver(RuleBackend):
        def plan(self, intent, compact, classes):
            seen.append(compact["page_type_hint"])
            return super().plan(intent, compact, classes)

    result = api.Engine(spark, Driver()).extract(layouts(spark, 12, cards), "Extract the title, price and url of all products", semantic=False)
    assert len(seen) == 12 and not Driver.in_tasks and RuleBackend.in_tasks
    assert result.records.where("page_id % 10 > 0").count() == 10 * 3


def test_repairs_are_by_layout(spark):
    """A plan whose container matches nothing is repaired by the next section, on the pages that need it."""

    class Wrong(RuleBackend):
        in_tasks = True

        def plan(self, intent, compact, classes):
            import dataclasses

            return dataclasses.replace(super().plan(intent, compact, classes), container="article.none")

        def repair(self, intent, plan, report, compact, classes):
            return RuleBackend.plan(self, intent, compact, classes) if report["n_records"] == 0 else None

    pages = layouts(spark, 6, lambda i: cards(i + 1))
    result = api.Engine(spark, Wrong()).extract(pages, "Extract the title, price and url of all products", semantic=False)
    assert result.repairs == 1 and result.records.count() == 18
    assert {r.diagnostics.repair_attempts for r in result.jobs.collect()} == {1}
    assert any("container: nothing matches" in r.diagnostics.warnings for r in result.jobs.collect())


def test_long_pages_are_cut_at_bytes_and_say_so(spark):
    from pagemill.settings import Settings

    html = "<h1 class=title>é</h1>" + "é" * 500
    result = api.Engine(spark, settings=Settings.of(max_html_bytes=501)).extract(layouts(spark, 1, lambda i: html), "Get the title for this page", semantic=False)
    (job,) = result.jobs.collect()
    assert "html_truncated" in job.diagnostics.warnings and result.records.first().record["title"] == "é"


def test_states_go_on_from_where_they_are(spark):
    rng = random.Random(8)
    states, rows, want = [], [], {}
    for k in range(120):
        state = ("candidate", 0, 0, 0.0)
        for _ in range(rng.randint(0, 12)):
            state = step(state, rng.random() < 0.6, round(0.6 + rng.random() * 0.4, 2))
        states.append((k, *state))
        for i in range(rng.randint(0, 9)):
            ok, score = rng.random() < 0.6, round(0.6 + rng.random() * 0.4, 2)
            rows.append((k, i, ok, score))
            state = step(state, ok, score)
            want[k] = state
    out = templates.advanced(spark.createDataFrame(states, "template_id long, status string, successes int, failures int, score double"), spark.createDataFrame(rows, "template_id long, ts long, success boolean, score double").repartition(3), order=("ts",))
    assert {r.template_id: (r.status, r.successes, r.failures, r.score) for r in out.collect()} == want
    assert {s[0] for s in want.values()} == {"candidate", "active", "needs_review", "deprecated"}


def test_options_still_bound_records(spark):
    result = api.Engine(spark).extract(layouts(spark, 2, lambda i: cards(i + 1)), "Extract the title, price and url of all products", options=Options(max_records=2), semantic=False)
    assert result.records.count() == 4


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div><p>{LONG}<p>short<p>{LONG} b</div>", f"{LONG}\nshort\n{LONG} b"),
        (f"<div><p>short<p>{LONG}<p>end</div>", LONG),
        (f"<ul><li><a href=x>{LONG}</a></ul><p>{LONG} and <a href=y>a link</a></p>", f"{LONG} and a link"),
        (f"<div class='user-comments'><p>{LONG}<p>{LONG}</div><p>{LONG} text</p>", f"{LONG} text"),
        (f"<h2>Head</h2><p>{LONG}</p><h3>Alone</h3>", f"Head\n{LONG}"),
        (f"<p>{LONG} first</p><p>a<p>b<p>c<p>{LONG} second</p><p>{LONG} third</p>", f"{LONG} second\n{LONG} third"),
        (f"<article><p>marked</article><p>{LONG}", "marked"),
        ("<p>a few<p>words", "a few\nwords"),
        ("", None),
    ],
)
def test_articles_by_density(spark, html, want):
    (row,) = parsed(spark, f"<body>{html}" if html else "").select(strategies.article(F.col("nodes"))["text"].alias("t")).collect()
    assert row.t == want


def test_bylines(spark):
    rows = parsed(spark, "<a rel=author href=x>By Ann B</a>", "<p class='post byline'>by: C", "<p class=authority>x", "<meta name=author content=M><i class=author>N").select("page_id", strategies.article(F.col("nodes"))["author"].alias("a"))
    assert {r.page_id: r.a for r in rows.collect()} == {0: "Ann B", 1: "C", 2: None, 3: "M"}
