"""The library's own operators on small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill import api
from pagemill.functions import normalize as norm
from pagemill.functions import text as txt
from pagemill.functions import urls
from pagemill.functions.embedded import embedded
from pagemill.operators import compliance, css, dom, jobs, merge, metrics, page, sections, strategies, templates, validate
from pagemill.plans.backend import RuleBackend
from pagemill.plans.model import FieldSelector, FieldSpec, Intent, Options, Plan
from pagemill.sources import export, store, webpage

CARDS = '<html><body><header><nav><a href="/1">1</a><a href="/2">2</a><a href="/3">3</a><a href="/4">4</a><a href="/5">5</a></nav></header><div class="grid">' + "".join(f'<article class="product-card"><h2 class="product-title">Thing {i}</h2><span class="price">${i}9.50</span><a class="link" href="/p/{i}">more</a></article>' for i in range(4)) + "</div></body></html>"
INTENT = Intent((FieldSpec("title", "string", True), FieldSpec("price", "currency", True), FieldSpec("url", "url")))
PLAN = Plan("repeated_dom_selector", container="article.product-card", fields=(FieldSelector("title", ".product-title"), FieldSelector("price", ".price"), FieldSelector("url", "a.link", "href")))


def pages_of(spark, *html):
    return spark.createDataFrame([(i, "https://x.example.com/a/list.html", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def parsed(spark, *html):
    rows = pages_of(spark, *html).withColumns({"markup_length": F.length("html"), "embedded": embedded(F.col("html"))})
    return dom.parse_pages(rows)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "kind", "want"),
    [
        ("  a   b\n", "string", "a b"), ("", "string", None), (None, "number", None), ("rated 4.7 of 5", "number", "4.7"), ("Page 12 of 30", "integer", "12"), ("now $89.99 only", "currency", "$89.99"), ("1,5 €", "currency", "1,5 €"), ("free", "currency", "free"),
        ("../b", "url", "https://x.example.com/b"), ("javascript:x()", "url", None), ("mail a.b@c.org!", "email", "a.b@c.org"), ("(555) 123-4567", "phone", "5551234567"), ("12345", "phone", None), ("January 5, 2024", "date", "2024-01-05"), ("soon", "date", None), ("31 Feb 2024", "date", None),
        ("In Stock", "boolean", "true"), ("out of stock", "boolean", "false"), ("maybe", "boolean", None), ("a, b;c |", "list_string", "a; b; c"), ("99999999999999999999", "integer", None),
    ],
)
def test_normalize(spark, raw, kind, want):
    assert one(spark, norm.normalize(F.lit(raw).cast("string"), kind, F.lit("https://x.example.com/a/list.html"))) == want


def test_fuzzy_dates_fill_from_a_fixed_day(spark):
    assert one(spark, norm.normalize(F.lit("on the 3rd of March 2021"), "date", fuzzy_dates=True)) == "2021-03-03"


@pytest.mark.parametrize(("url", "want", "domain"), [("HTTPS://Sub.Example.co.uk:443/a?utm_source=x&b=2&a=1#f", "https://sub.example.co.uk/a?a=1&b=2", "example.co.uk"), ("http://x.com:8080", "http://x.com:8080/", "x.com"), ("ftp://x.com", None, None), ("", None, None), ("https://", None, None), ("http://x.com/?q=a%20b&e=", "http://x.com/?e=&q=a+b", "x.com")])
def test_normalize_url(spark, url, want, domain):
    got = one(spark, urls.normalize_url(F.lit(url)))
    assert (got.canonical, got.domain) == (want, domain)
    assert (got.error is None) == (want is not None)
    if want:
        assert one(spark, urls.normalize_url(F.lit(want))).canonical == want


def test_patterns_and_signatures(spark):
    assert one(spark, urls.url_pattern(F.lit("https://x/p/123/deadbeef01/blue-shoe-9/about"))) == "/p/*/*/*/about"
    sig = lambda *n: one(spark, txt.goal_signature(F.array(*map(F.lit, n))))
    assert sig("price", "Title") == sig("title", "price") != sig("title")
    match = lambda path, glob: one(spark, F.rlike(F.lit(path), urls.glob_regex(F.lit(glob))))
    assert match("/a/b/c.x", "/a/*") and match("/a?c", "/a[?]c") and not match("/a", "/b*") and match("/ab", "/?b")


@pytest.mark.parametrize(
    ("selector", "want"),
    [("li", ["one", "two x y"]), ("ul > li:first-child", ["one"]), ("li + li", ["two x y"]), ("p:nth-of-type(2n)", ["y"]), ("li p:last-child", ["y"]), ("#k, li:first-child", ["K", "one"]), ("[data-x^='a']", ["K"]), ("b:not(.z)", ["K"]), ("li:contains('x y')", ["two x y"]), ("b:hover", []), ("b ~ ul li:only-child", []), (">", [])],
)
def test_selectors(spark, selector, want):
    df = parsed(spark, "<div><b id=k data-x=abc>K</b><ul><li>one<li>two <p>x <p>y</ul></div><script>li</script>")
    nodes = F.col("nodes")
    assert df.select(F.transform(css.select_all(nodes, selector), lambda n: dom.text_of(nodes, n))).first()[0] == want


def test_bad_selectors(spark):
    with pytest.raises(css.InvalidSelectorError):
        css.clauses("a" * 501)
    with pytest.raises(ValueError):
        FieldSelector("a", "b", "onclick")
    assert FieldSelector("a", "b", "data-product-id")


def test_odd_markup_never_fails(spark):
    df = parsed(spark, None, "", "<", "<p><b>a<p>b</article></p>", "<![bad[x", "<a href=x " * 50, "plain &amp; text")
    assert [r[0] for r in df.orderBy("page_id").select(page.visible_text(F.col("nodes"))).collect()][-1] == "plain & text"


def test_sections_find_cards_and_not_navigation(spark):
    rows = {r.page_id: r.sections for r in sections.candidate_sections(parsed(spark, CARDS, "<nav>" + "<a href=x><b>1</b><i>2</i></a>" * 5 + "</nav><p>x</p>")).collect()}
    assert rows[0][0].selector == "article.product-card" and rows[0][0]["count"] == 4 and 0 < rows[0][0].confidence <= 1
    assert 1 not in rows


def test_repeated_records(spark):
    got = [r.record for r in strategies.execute(parsed(spark, CARDS), PLAN, INTENT).orderBy("row_idx").collect()]
    assert got[1] == {"title": "Thing 1", "price": "$19.50", "url": "https://x.example.com/p/1"} and len(got) == 4
    assert strategies.execute(parsed(spark, CARDS), Plan("repeated_dom_selector", container=".none", fields=PLAN.fields), INTENT).count() == 0
    assert strategies.execute(parsed(spark, CARDS), PLAN, INTENT, 2).count() == 2


def test_structured_data(spark):
    html = '<meta property="og:title" content="T"><script type="application/ld+json">{"@graph":[{"@type":["Product","Thing"],"name":"A","brand":{"name":"B"}}]}</script><script type="application/ld+json">{bad</script><script id="__NEXT_DATA__">{"title":"N"}</script>'
    df = parsed(spark, html, "<p>none</p>")
    e = {r.page_id: r.embedded for r in df.collect()}
    assert e[0].json_ld_types == ["Product", "Thing"] and e[0].open_graph == {"og:title": "T"} and e[0].next_data_present and len(e[0].payloads) == 2
    assert e[1].json_ld_types == [] and e[1].open_graph == {} and not e[1].next_data_present
    got = [r.record for r in strategies.execute(df, Plan("structured_data"), Intent((FieldSpec("name"), FieldSpec("brand"), FieldSpec("title")))).orderBy("row_idx").collect()]
    assert got == [{"name": "A", "brand": "B"}, {"title": "N"}]


def test_tables_without_headers_keep_their_first_row(spark):
    html = "<table><tr><td>name<td>price<tr><td>A<td>3</table>"
    got = [r.record for r in strategies.execute(parsed(spark, html), Plan("table_extraction"), Intent((FieldSpec("name"), FieldSpec("price", "number")))).orderBy("row_idx").collect()]
    assert got == [{"name": "name"}, {"name": "A", "price": "3.0"}]


def report_of(spark, records, intent=INTENT, containers=None):
    df = spark.createDataFrame([("j", r) for r in records], "job_id string, record map<string,string>")
    return validate.validate(spark.createDataFrame([("j", containers)], "job_id string, containers int"), df, intent).first()


def test_validation(spark):
    none = report_of(spark, [], containers=10)
    assert none.needs_repair and not none.is_good_enough
    full = [{"title": f"t{i}", "price": "$1", "url": f"https://x/{i}"} for i in range(2)]
    good = report_of(spark, full, containers=2)
    assert good.is_good_enough and good.overall_score >= 0.8
    lacks = report_of(spark, [{"title": "a"}, {"title": "b"}, {"title": "c"}], containers=3)
    assert lacks.needs_repair and lacks.missing["price"] == 3
    twice = report_of(spark, [full[0], full[0], full[1]], containers=3)
    assert twice.duplicate_count == 1 and twice.duplication_score < 1
    single = report_of(spark, full[:1], Intent(INTENT.fields, expected="object"))
    assert single.record_count_score == 1.0


def test_merge_prefers_plausible_and_short(spark):
    schema = "job_id string, row_idx int, record map<string,string>"
    a = spark.createDataFrame([("j", 0, {"title": "Long title", "price": "$1"}), ("j", 1, {"title": "x"})], schema)
    b = spark.createDataFrame([("j", 0, {"title": "Short", "price": "$2"}), ("j", 2, {"title": ""})], schema)
    got = {r.row_idx: r.record for r in merge.merge_records(a, b, INTENT).collect()}
    assert got == {0: {"title": "Short", "price": "$2"}, 1: {"title": "x"}}
    assert {r.row_idx: r.record for r in merge.merge_records(a, a.limit(0), INTENT).collect()} == {0: {"title": "Long title", "price": "$1"}, 1: {"title": "x"}}


def test_template_states(spark):
    from pagemill.streaming import step

    plan = [True, True, True, False, False, True, True, False, False, False, False, False, True]
    rows = [(1, i, i, s, 0.9) for i, s in enumerate(plan)]
    df = spark.createDataFrame(rows, "template_id long, ts long, event_id long, success boolean, score double")
    got = templates.lifecycle(df).first()
    state = ("candidate", 0, 0, 0.0)
    seen = []
    for s in plan:
        state = step(state, s, 0.9)
        seen.append(state[0])
    assert (got.status, got.successes, got.failures) == state[:3] == ("deprecated", 1, 0)
    assert seen[2] == "active" and seen[4] == "needs_review" and seen[6] == "active" and seen[11] == "deprecated"


@pytest.fixture
def many_segments(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_templates_are_dealt_over_tasks(spark, many_segments):
    """Streaks, states and starts of a key that reaches over several segments, against a plain fold."""
    import random

    from pagemill.operators import segments
    from pagemill.streaming import step

    rng = random.Random(1)
    rows = [(k, i, i, rng.random() < p, round(rng.random() * 0.4 + 0.6, 3)) for k, n, p in ((1, 900, 0.9), (2, 30, 0.4), (3, 300, 0.995), (4, 40, 0.05), (5, 1, 1.0), (6, 120, 0.7)) for i in range(n)]
    df = spark.createDataFrame(rows, "template_id long, ts long, event_id long, success boolean, score double").repartition(5)
    assert segments.segmented(df, "template_id", ("ts", "event_id")).where("template_id = 1").select(segments.SEGMENT).distinct().count() > 1
    run, streak, states = None, {}, {}
    for k, i, _, ok, score in rows:
        run = run + 1 if i and last == ok else 1  # noqa: F821
        last = ok  # noqa: F841
        streak[k, i] = run
        states[k] = step(states.get(k, ("candidate", 0, 0, 0.0)), ok, score)
    assert {(r.template_id, r.ts): r.streak for r in templates.streaks(df).collect()} == streak
    assert {r.template_id: (r.status, r.successes, r.failures, r.score) for r in templates.lifecycle(df).collect()} == states
    assert len({s[0] for s in states.values()}) >= 3
    arrivals = df.select(F.col("template_id").alias("domain"), (F.col("ts") * 0.7).alias("at"), F.col("event_id").alias("seq"))
    for burst in (1, 3):
        got = {(r.domain, r.seq): r.start for r in jobs.rate_schedule(arrivals, burst=burst).collect()}
        for k in (1, 3):
            full = 0.0  # when the bucket would be full of debts
            for i in range(900 if k == 1 else 300):
                at = i * 0.7
                assert got[k, i] == pytest.approx(max(at, full - (burst - 1)), abs=1e-6)
                full = max(at, full) + 1.0


def test_template_stream_matches_batch(spark, tmp_path):
    from pagemill import streaming

    rows = [(k, i, i, (i * 7 + k) % 3 > 0, 0.9) for k in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "template_id long, ts long, event_id long, success boolean, score double")
    df.write.parquet(str(tmp_path / "in"))
    out = streaming.lifecycle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.template_id: (r.status, r.successes, r.failures) for r in spark.table("states").collect()}
    assert got == {r.template_id: (r.status, r.successes, r.failures) for r in templates.lifecycle(df).collect()}


def test_rate_schedule(spark):
    df = spark.createDataFrame([("d", t, i) for i, t in enumerate([0.0, 0.1, 0.2, 5.0])], "domain string, at double, seq int")
    assert [r.start for r in jobs.rate_schedule(df).orderBy("seq").collect()] == [0.0, 1.0, 2.0, 5.0]


def test_histogram_places(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [5, 1, 4, 2, 2, 3]], "name string, value double")
    r = metrics.histograms(df, ["name"]).first()
    values = sorted([5, 1, 4, 2, 2, 3])
    assert (r["count"], r.p50, r.p95, r.p99) == (6, values[3], values[5], values[5])


def test_compliance(spark):
    assert not compliance.address_is_public("127.0.0.1") and compliance.address_is_public("8.8.8.8") and not compliance.address_is_public("x")
    pages = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/private/x"), ("b", "https://b/")], "host string, canonical string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private")], "host string, rules string")
    assert sorted((r.canonical, r.robots) for r in compliance.robots_verdict(pages, robots, "pagemill").collect()) == [("https://a/private/x", "disallowed"), ("https://a/x", "allowed"), ("https://b/", "no_robots")]


def test_fetch_errors_are_rows(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("down")
        return url, 200, "text/html" if "ok" in url else "image/png", b"<p>\xff", None

    got = {r.url: (r.html, (r.error or "").split(":")[0]) for r in webpage.fetched(spark.createDataFrame([(1, "ok", "a"), (2, "bad", "a"), (3, "png", "b")], "page_id long, url string, host string"), fetch).collect()}
    assert got == {"ok": ("<p>�", ""), "bad": (None, "fetch_error"), "png": (None, "unsupported_content_type")}


def test_export(spark):
    df = spark.createDataFrame([(0, 0, {"b": "1", "a": 'x"y'}), (0, 1, {"c": "q,r"})], "page_id long, row_idx int, record map<string,string>")
    assert sorted(export.header_of(df)) == ["a", "b", "c"]
    flat = export.flattened(df, ["a", "c"])
    assert [r[0] for r in export.csv_text(flat).collect()] == ['"x""y",\r\n', ',"q,r"\r\n']
    typed = spark.createDataFrame([(["a", "b"], {"k": 1, "j": 2}, None)], "l array<string>, m map<string,int>, n int")
    assert tuple(export.cells(typed).first()) == ("a; b", "j=2; k=1", "")


def test_store_keeps_the_latest_version(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.migrate()
    names = [c.split()[0] for c in store.JOBS.split(", ")]
    base = spark.range(1).select(*(F.lit(None).alias(n) for n in names)).withColumn("id", F.lit("1"))
    typed = lambda status, at: base.withColumns({"status": F.lit(status), "updated_at": F.lit(at)}).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in store.JOBS.split(", ")))
    s.append("jobs", typed("running", "2024-01-01 00:00:00"))
    s.append("jobs", typed("success", "2024-01-02 00:00:00"))
    assert [r.status for r in s.table("jobs").collect()] == ["success"]


def test_engine_plans_and_extracts(spark):
    result = api.Engine(spark).extract(pages_of(spark, CARDS), "Extract the title, price and url of all products")
    assert result.plan.strategy == "repeated_dom_selector"
    rows = result.table().orderBy("row_idx").collect()
    assert [r.title for r in rows] == [f"Thing {i}" for i in range(4)] and rows[0].price == "$09.50"
    assert result.statuses().first().status == "success"
    assert Plan.from_json(result.plan.to_json()) == result.plan


def test_intents_and_options():
    i = RuleBackend().intent("Get the name and e-mail of each speaker")
    assert [f.name for f in i.fields] == ["name", "e_mail"] and i.expected == "array"
    with pytest.raises(ValueError):
        Options(max_records=0)
    with pytest.raises(ValueError):
        FieldSpec("Bad Name")


def test_sql_table_functions(spark):
    from pagemill import sql

    sql.register(spark)
    pages_of(spark, "<table><tr><th>a<th>b<tr><td>1<td>2</table><a href='../x'>go</a>").createOrReplaceTempView("p")
    assert [tuple(r) for r in spark.sql("select l.* from p, lateral html_links(html, url) l").collect()] == [("go", "https://x.example.com/x")]
    assert sorted(r.cells for r in spark.sql("select t.* from p, lateral html_tables(html) t").collect()) == [["1", "2"], ["a", "b"]]
    assert spark.sql("select count(*) n from p, lateral html_nodes(html) n").first().n == 8


def test_data_source_reads_nothing_from_nothing(spark):
    webpage.register(spark)
    assert spark.read.format("webpage").load().count() == 0


def test_page_facts(spark):
    html = "<title>T</title><dl><dt>A<dd>1<dt>B<dd>2</dl><table><tr><td>a<td>9</table><b class=label>C</b><i>3</i><p>some longer text here</p><a href='/e.ics'>cal</a>"
    df = parsed(spark, html).withColumn("facts", page.facts(F.col("nodes"), F.col("url"), F.col("embedded")))
    f = df.select("facts", page.facts_text(F.col("facts")).alias("t")).first()
    assert [(p.label, p.value) for p in f.facts.key_value_pairs] == [("A", "1"), ("B", "2"), ("C", "3")]
    assert f.facts.calendar_urls == ["https://x.example.com/e.ics"] and "## Pairs\n- A: 1" in f.t
    compact = page.analyze(parsed(spark, CARDS)).select("compact", page.compact_text(F.col("compact")).alias("j"), page.static_is_enough(F.col("compact"), F.col("embedded"), "array", ["title"]).alias("s")).first()
    assert compact.compact.page_type_hint == "search_results" and compact.j.startswith("{") and compact.s is False


def test_engine_warm_path(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "store"))
    own.migrate()
    ask = "Extract the title and price of all products"
    pages = spark.createDataFrame([(i, f"https://x.example.com/list/{i}", CARDS) for i in range(2)] + [(2, "https://y.example.com/about", "<p>nothing here")], "page_id long, url string, html string")

    class Counting(RuleBackend):
        plans = 0

        def plan(self, *a):
            Counting.plans += 1
            return super().plan(*a)

    engine = api.Engine(spark, Counting(), store=own, artifacts_path=str(tmp_path / "artifacts"))
    first = engine.extract(pages, ask)
    assert Counting.plans == 2  # two layouts, not three pages
    jobs_of = {r.page_id: r for r in first.jobs.collect()}
    assert [jobs_of[i].status for i in range(3)] == ["success", "success", "partial_success"]  # no records score 0.35
    assert jobs_of[0].diagnostics.strategy_used == "repeated_dom_selector" and jobs_of[0].diagnostics.field_coverage == {"title": 1.0, "price": 1.0}
    assert jobs_of[2].diagnostics.records_found == 0 and jobs_of[2].message == "no records were found"
    assert first.records.where("page_id < 2").count() == 8
    assert [(t.domain, t.url_pattern, t.status, t.consecutive_successes) for t in engine.templates().collect()] == [("example.com", "/list/*", "candidate", 1)]
    # the same requests again: answered from the store
    again = engine.extract(pages, ask)
    assert sorted((r.page_id, r.status, r.message) for r in again.jobs.collect()) == [(i, jobs_of[i].status, "cached_idempotent_response") for i in range(3)]
    assert again.records.where("page_id < 2").count() == 8 and Counting.plans == 2
    # another page of the layout: served by the template, without a plan
    more = engine.extract(spark.createDataFrame([(7, "https://x.example.com/list/7", CARDS)], "page_id long, url string, html string"), ask)
    assert Counting.plans == 2 and more.jobs.first().diagnostics.template_used and more.records.count() == 4
    assert [(t.status, t.consecutive_successes) for t in engine.templates().collect()] == [("candidate", 2)]
    # a page of the layout that the template does not serve is planned, and counts against it
    other = engine.extract(spark.createDataFrame([(8, "https://x.example.com/list/8", "<p>x")], "page_id long, url string, html string"), ask)
    assert Counting.plans == 3 and not other.jobs.first().diagnostics.template_used
    assert [(t.consecutive_successes, t.consecutive_failures) for t in engine.templates().collect()] == [(0, 1)]
    counters, quality = engine.metrics()
    assert {r.key: r.total for r in counters.collect()}["extraction_total{status=success}"] == 3.0 and quality.count() >= 1
    from pagemill.sources import artifacts

    assert {r.kind for r in artifacts.read_artifacts(spark, str(tmp_path / "artifacts")).select("kind").distinct().collect()} == {"plan", "result", "compact"}
    artifacts.dump_metrics(counters, quality, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == counters.count() + quality.count()
    first.save_json(str(tmp_path / "json"))
    first.save_csv(str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "json")).count() == first.records.count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count()
    assert '"status" : "success"' in first.response_json().where("json like '%list/0%'").first().json
    engine.close()
    with pytest.raises(ValueError):
        engine.templates()


def test_analysis_parses_once(spark):
    rows = page.analyze(parsed(spark, CARDS)).select("page_id", "compact")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_large_pages_cost_their_nodes(spark):
    import time

    n = 3_200
    rows = "<table>" + "".join(f"<tr><td>label {i}<td>value {i}" for i in range(n)) + "</table>" + "".join(f"<b class=label>l{i % 7}</b><i></i><i>v{i}</i>" for i in range(n))
    cards = "".join(f"<article class=card><h2>T {i}</h2><a href=/{i}>x</a><ul><li><b>1</b><i>2</i></li><li><b>1</b><i>3</i></li><li><b>1</b><i>4</i></li></ul></article>" for i in range(n))
    df = parsed(spark, rows, f"<div>{cards}</div>").cache()
    assert df.count() == 2
    began = time.perf_counter()
    assert df.where("page_id = 0").select(F.size(page.key_values(F.col("nodes")))).first()[0] == 40
    found = df.where("page_id = 1").select(sections.sections_of(F.col("nodes"))).first()[0]
    assert found[0].selector == "article.card" and found[0]["count"] == n
    assert time.perf_counter() - began < 30  # quadratic ones took minutes


@pytest.mark.parametrize(("raw", "kind", "want"), [("1,5", "number", True), ("1.5e3", "number", True), ("1,234.5", "number", False), ("x", "number", False), ("3rd March 2021", "date", True), ("03/04/2024", "date", True), ("soon", "date", False), ("http:x", "url", True), ("ftp://x", "url", False), ("-12", "integer", True), ("1.0", "integer", False), ("no", "boolean", True), ("maybe", "boolean", False), ("a@b.co", "email", True), ("5 EUR", "currency", True), (None, "string", False)])
def test_values_parse_as_their_types(spark, raw, kind, want):
    assert spark.range(1).select(norm.parses_as(F.lit(raw).cast("string"), kind, fuzzy_dates=True)).first()[0] is want


def test_strategies_read_dates_in_any_wording(spark):
    html = "<div class=e><b class=t>A</b><i class=d>on the 3rd of March 2021</i></div><div class=e><b class=t>B</b><i class=d>2024-05-06</i></div><div class=e><b class=t>C</b><i class=d>soon</i></div>"
    plan = Plan("repeated_dom_selector", container=".e", fields=(FieldSelector("title", ".t"), FieldSelector("day", ".d")))
    got = {r.record["title"]: r.record.get("day") for r in strategies.execute(parsed(spark, html), plan, Intent((FieldSpec("title"), FieldSpec("day", "date")))).collect()}
    assert got == {"A": "2021-03-03", "B": "2024-05-06", "C": None}


def test_semantic_by_an_extractor(spark):
    df = parsed(spark, "<title>T</title>", "<title>bad</title>").withColumn("facts", page.facts(F.col("nodes"), F.col("url"), F.col("embedded")))

    def extract(text, intent, most):
        if "bad" in text:
            raise RuntimeError("no answer")
        return [{"name": "a", "price": "$3", "tags": ["x", "y"], "other": 1}, {"name": None}, {"name": "b", "price": 4}]

    intent = Intent((FieldSpec("name"), FieldSpec("price", "currency"), FieldSpec("tags", "list_string")))
    got = sorted((r.page_id, r.row_idx, r.record) for r in strategies.semantic_by(df, intent, extract).collect())
    assert got == [(0, 0, {"name": "a", "price": "$3", "tags": "x; y"}), (0, 2, {"name": "b", "price": "4"})]
    result = api.Engine(spark).extract(pages_of(spark, "<title>T</title>"), intent=intent, extractor=extract)
    assert result.records.count() == 2


def test_gateway_asks_once_more():
    from pagemill.plans.backend import Gateway, GatewayError, ModelBackend, is_reasoning_model

    answers, seen = ["no json", '{"fields":[{"name":"title","required":true}],"expected":"object"}', "{}", "[]"], []

    def call(prompt, model, **options):
        seen.append((options, "wrong" in prompt))
        return answers[len(seen) - 1], 5, 2

    gateway = Gateway(call, "small")
    intent = ModelBackend(gateway).intent("Give me the title")
    assert intent == Intent((FieldSpec("title", "string", True),), expected="object")
    assert seen == [({"temperature": 0.2}, False), ({"temperature": 0.0}, True)] and [e["outcome"] for e in gateway.log] == ["invalid", "ok"]
    with pytest.raises(GatewayError):
        ModelBackend(gateway).intent("Give me the title")
    assert is_reasoning_model("O3-mini") and not is_reasoning_model("small")


def test_rendering(spark):
    from pagemill.sources import render

    class Fake(render.Renderer):
        def render(self, url):
            if "bad" in url:
                raise OSError("crash")
            return CARDS

    df = spark.createDataFrame([(0, "https://x.example.com/a/1", "<p>js"), (1, "https://x.example.com/bad", "<p>js")], "page_id long, url string, html string")
    found = render.rendered(df, Fake, workers=2, recycle=1)
    assert {r.page_id: (r.rendered_html is not None, r.render_error) for r in found.collect()} == {0: (True, None), 1: (False, "render_error: crash")}
    before = render.pre_rendered(df, df.limit(1).select("url", F.lit("<b>").alias("html")))
    out = {r.page_id: (r.html, r.mode) for r in render.with_rendered(df, before, F.lit(True)).collect()}
    assert out == {0: ("<b>", "browser"), 1: ("<p>js", "static")}
    result = api.Engine(spark, opener=Fake).extract(df, "Extract the title, price and url of all products")
    assert {r.page_id: r.diagnostics["mode"] for r in result.jobs.collect()} == {0: "browser", 1: "static"} and result.records.where("page_id = 0").count() == 4


def test_robots_source_keeps_what_is_fresh(spark):
    hosts = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "host string")
    known = spark.sql("select 'a' host, 'old' rules, timestamp'2024-01-01 00:00:00' fetched_at union all select 'b', 'fresh', timestamp'2024-01-01 01:30:00'")

    def fetch(url):
        if "//c/" in url:
            raise OSError("down")
        return f"rules of {url}"

    got = {r.host: r.rules for r in compliance.robots_source(hosts, fetch, now=F.expr("timestamp'2024-01-01 02:00:00'"), known=known).collect()}
    assert got == {"a": "rules of https://a/robots.txt", "b": "fresh", "c": None}


def test_rate_bursts_and_waits(spark):
    df = spark.createDataFrame([("d", t, i) for i, t in enumerate([0.0, 0.0, 0.0, 0.0, 9.0, 9.0])], "domain string, at double, seq int")
    rows = jobs.rate_schedule(df, burst=2, wait=1.5).orderBy("seq").collect()
    assert [r.start for r in rows] == [0.0, 0.0, 1.0, 2.0, 9.0, 9.0] and [r.given_up for r in rows] == [False, False, False, True, False, False]


def test_settings(spark):
    from pagemill.settings import Settings

    spark.conf.set("spark.pagemill.max_records", "7")
    try:
        assert Settings.from_spark(spark, rate_burst=3) == Settings.of(max_records=7, rate_burst=3)
    finally:
        spark.conf.unset("spark.pagemill.max_records")
    with pytest.raises(ValueError, match="colour"):
        Settings.of(colour="red")


def test_following_links(spark):
    engine = api.Engine(spark)
    first = engine.extract(pages_of(spark, CARDS), "Extract the title, price and url of all products")
    fetch = lambda urls: urls.withColumn("html", F.concat(F.lit("<h1 class=title>"), F.substring_index("url", "/", -1), F.lit("</h1>")))
    second = engine.follow(first, "url", fetch, "Get the title for this page")
    assert sorted(r.title for r in second.table().collect()) == ["0", "1", "2", "3"]


def test_command_line(spark, tmp_path, capsys):
    from pagemill.cli import main

    pages_of(spark, CARDS).write.parquet(str(tmp_path / "pages"))
    assert main(["migrate", str(tmp_path / "store")]) == 0
    args = ["extract", str(tmp_path / "pages"), "Extract the title, price and url of all products", "--store", str(tmp_path / "store")]
    assert main([*args, "--format", "csv"]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["title,price,url", "Thing 0,$09.50,https://x.example.com/p/0"]
    assert main(["templates", str(tmp_path / "store")]) == 0
    assert "candidate" in capsys.readouterr().out
    assert main(["version"]) == 0
