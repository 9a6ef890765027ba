"""Queries and operators on tables of other layouts and sizes than the given ones."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pagemill import api
from pagemill.operators import dom, interpreter, page, strategies
from pagemill.plans.model import FieldSelector, FieldSpec, Intent, Options, Plan
from pagemill.settings import Settings
from pagemill.sources.store import Store


@pytest.mark.parametrize("files", [0, 1, 3])
def test_streams_read_tables_that_are_folders(spark, tmp_path, files):
    html = "<html><head><title>Page {0}</title></head><body><p>text {0}</p></body></html>"
    rows = [(i, f"https://x.example.com/{i}", html.format(i)) for i in range(7 if files else 0)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(max(files, 1)).write.parquet(str(tmp_path / "pages.parquet"))
    out = __spark_entry__.queries()["stream_pages"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.title, r.visible_length) for r in out) == [(i, f"Page {i}", 6) for i, _, _ in rows]


def test_streams_read_tables_that_are_files(spark, tmp_path):
    folder = tmp_path / "out"
    spark.createDataFrame([(1, "https://x.example.com/1", "<title>One</title>")], "page_id long, url string, html string").coalesce(1).write.parquet(str(folder))
    next(folder.glob("part-*")).rename(tmp_path / "pages.parquet")
    assert [r.title for r in __spark_entry__.queries()["stream_pages"](spark, str(tmp_path)).collect()] == ["One"]


def test_references_without_semicolon(spark, tmp_path):
    html = "<html><head><title>A &amp;&lt; B &amp</title></head><body><script>a && b &amp c</script><h1>A &amp</h1><article><p>x &copy; &lt y &</p></article></body></html>"
    of = lambda whole: [n[dom.AT_TEXT] for n in dom.parse(html, whole) if n[dom.AT_TEXT]]
    assert of(False) == ["A &< B &", "a && b &amp c", "A &", "x © < y &"]
    assert of(True) == ["A &< B &amp", "a && b &amp c", "A &amp", "x © &lt y &"]
    spark.createDataFrame([(1, "https://x.example.com/1", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    run = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).first()
    assert run("page_title").title == "A &< B &amp" and run("page_headings").headings == run("page_article").title == "A &amp"
    assert run("page_text_metrics").visible_length == run("stream_pages").visible_length == len("A &ampx © &lt y &")


def test_all_records_of_long_pages(spark):
    html = "<div>" + "".join(f'<article class="c"><h2 class="title">Thing {i}</h2><a class="url" href="/p/{i}">more</a></article>' for i in range(1500)) + "</div>"
    rows = "<table>" + "".join(f"<tr><td>{i}" for i in range(1500)) + "</table>"
    intent = Intent((FieldSpec("title", "string", True),))
    pages = dom.parse_pages(spark.createDataFrame([(1, "https://x.example.com/l/1", html)], "page_id long, url string, html string"))
    plan = Plan("repeated_dom_selector", container="article.c", fields=(FieldSelector("title", "h2"),))
    want = [(i, f"Thing {i}") for i in range(1500)]
    of = lambda found: sorted((r.row_idx, r.record["title"]) for r in found.collect())
    assert of(strategies.execute(pages, plan, intent)) == of(interpreter.run_plans(pages.withColumn("plan", F.lit(plan.to_json())), intent)[0]) == want
    assert of(strategies.execute(pages, plan, intent, 700)) == of(interpreter.run_plans(pages.withColumn("plan", F.lit(plan.to_json())), intent, 700)[0]) == want[:700]
    table = dom.parse_pages(spark.createDataFrame([(1, "https://x.example.com/l/1", "<table><tr><th>Title</th></tr>" + rows[7:])], "page_id long, url string, html string"))
    assert strategies.execute(table, Plan("table_extraction"), intent).count() == 1500
    engine = api.Engine(spark, settings=Settings.of(max_records=0, max_html_bytes=0))
    out = engine.extract(spark.createDataFrame([(1, "https://x.example.com/l/1", html)], "page_id long, url string, html string"), options=Options(max_records=None), intent=intent, plan=plan, semantic=False)
    assert of(out.records) == want


def test_parts_of_pages_are_bounded():
    sizes = [1, 0, 5, 9, 100, 2, 2] + [0] * 200
    parts = list(dom.in_parts(sizes, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or (sum(sizes[a:b]) <= 10 and b - a <= dom.PART_ROWS) for a, b in parts)
    assert not list(dom.in_parts([], 10))


PIECES = ["<p>", "</p>", "<dl>", "<dt>", "<dd>", "</dl>", "<table>", "<tr>", "<td>", "</table>", '<b class="label">', "</b>", "<i>", "</i>", '<td class="Key x">', "A", "b  c ", " ", "\x1c", "\u2003", "&amp;", "&#x1;", "&lt", "&", "x < y", "<", ">", "<br/>", "<script>", "</script>", "<title>", "<!-- x -->", "<?pi?>", '<a href="x>y">', "</A >", "<textarea>", "</", "<p"]


def mixed_pages():
    import random

    dice = random.Random(3)
    pages = ["".join(dice.choice(PIECES[:20] if k % 2 else PIECES) for _ in range(dice.randint(0, 12))) for k in range(600)]
    pages += ["<dl>" + "".join(f"<dt>k{i}<dd>{i}" for i in range(n)) + '</dl><b class="label">L</b><i>1</i>' for n in (29, 30, 45)]
    pages += ['<b class="label">' + "l" * n + "</b>" + "<i></i>" * m + f"<i>{'v' * 400}</i>" for n in (80, 81) for m in (4, 5)]
    return pages * 2 + ["<table>" + "<tr><td>A<td>" + "x" * 9000, None, ""]


def test_outlines_are_what_the_parse_gives():
    for html in mixed_pages():
        for whole in (False, True):
            outline, texts = dom.outlined(html, whole)
            nodes = [list(n) for n in outline.nodes]
            for at, text in zip(outline.texts_at, texts, strict=True):
                nodes[at][dom.AT_TEXT] = text
            assert nodes == dom.parse(html, whole), html


def test_tags_that_pages_share_are_parsed_once(monkeypatch):
    calls, parse = [], dom.parse
    monkeypatch.setattr(dom, "parse", lambda *a: calls.append(a) or parse(*a))
    dom._outlines.clear()
    for i in range(500):
        dom.outlined(f"<dl><dt>Name<dd>{i}</dl>")
    assert len(calls) == 1
    for i in range(500):
        dom.outlined(f'<dl><dt class="c{i}">Name<dd>{i}</dl>')
    assert len(dom._outlines) <= dom.OUTLINES


def test_pairs_of_the_parse_are_those_of_the_nodes(spark):
    pages = spark.createDataFrame(list(enumerate(mixed_pages())), "page_id long, html string").repartition(4)
    both = dom.parse_pages(pages, pairs="pairs").select("page_id", page.key_values(F.col("nodes")).alias("a"), page.pairs_said(F.col("pairs")).alias("b"))
    rows = both.collect()
    assert len(rows) == len(mixed_pages()) and [r.page_id for r in rows if r.a != r.b] == [] and sum(map(len, (r.a for r in rows))) > 100
    alone = dom.parse_pages(pages, column=None, pairs="pairs")
    assert alone.columns == ["page_id", "pairs"] and alone.count() == len(rows)


def test_few_large_pages_are_dealt(spark):
    html = "<div>" + '<article class="c"><h2>Thing</h2></article>' * 5 + "</div>"
    rows = [(i, f"https://x.example.com/list/{i}", html) for i in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    tasks = [r["count"] for r in api.Engine(spark).prepared(pages).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 24 and len(tasks) >= 8 and max(tasks) <= 6


def test_templates_serve_pages_that_are_parsed_once(spark, tmp_path, monkeypatch):
    own, real = Store(spark, str(tmp_path / "store")), api.parse_pages
    own.migrate()
    marks = str(tmp_path / "parsed")

    def counted(pages, *given):
        def mark(batches):
            for pdf in batches:
                with open(marks, "a") as f:
                    f.writelines(f"{i}\n" for i in pdf["page_id"])
                yield pdf

        return real(pages.mapInPandas(mark, pages.schema), *given)

    monkeypatch.setattr(api, "parse_pages", counted)
    html = "<div>" + "".join(f'<article class="c"><h2 class="title">Thing {i}</h2><span class="price">${i}.50</span></article>' for i in range(5)) + "</div>"
    page_of = lambda i: (i, f"https://x.example.com/list/{i}", html)
    engine, ask = api.Engine(spark, store=own), "Extract the title and price of all products"
    for ids in (range(3), range(8)):
        out = engine.extract(spark.createDataFrame([page_of(i) for i in ids], "page_id long, url string, html string"), ask, semantic=False)
    assert sorted((r.page_id, r.message == "cached_idempotent_response") for r in out.jobs.collect()) == [(i, i < 3) for i in range(8)]
    assert all(r.template_used for r in out.jobs.where("page_id >= 3").select("diagnostics.template_used").collect())
    assert sorted(map(int, Path(marks).read_text().split())) == list(range(8))


def test_node_tables_have_the_values_of_their_arrays():
    pages = [dom.outlined(html) for html in mixed_pages()]
    every = dom._lists(pages)
    for nodes in (every, every.slice(7, 40), every.slice(3, 0), every.slice(len(every) - 1)):
        table = interpreter.NodeTable(nodes)
        listed = nodes.to_pylist()
        rows = [n for page_nodes in listed for n in page_nodes]
        assert [b - a for a, b in zip(table.offsets, table.offsets[1:], strict=False)] == [len(page_nodes) for page_nodes in listed]
        assert table.tag == [n["tag"] for n in rows] and table.text == [n["text"] for n in rows]
        assert table.attrs == [dict(n["attrs"] or {}) for n in rows]
        assert table.numbers == {name: [n[name] for n in rows] for name in table.numbers}
        assert all(type(v) is int for values in table.numbers.values() for v in values)


def test_texts_are_a_page_s_own_where_tags_were_seen_before():
    """Also where each page of a part has tags of its own, all of them kept from pages of earlier parts."""
    dom._outlines.clear()
    for part in ([("p", "a"), ("p", "b"), ("b", "c")], [("p", "d")], [("b", "e"), ("p", "f")], [("i", "g"), ("p", "h")]):
        every = dom._lists([dom.outlined(f"<{tag}>{text}</{tag}>") for tag, text in part]).to_pylist()
        assert [(nodes[0]["tag"], nodes[1]["text"]) for nodes in every] == part


def test_lists_of_parts_are_what_the_parse_gives():
    pages = mixed_pages()
    names = dom.NODE.fieldNames()
    for size in (1, 2, 3, 50):
        dom._outlines.clear()
        got = [nodes for a in range(0, len(pages), size) for nodes in dom._lists([dom.outlined(html) for html in pages[a : a + size]]).to_pylist()]
        for html, nodes in zip(pages, got, strict=True):
            want = [dict(zip(names, n, strict=True)) for n in dom.parse(html)]
            assert [{**n, "attrs": dict(n["attrs"])} for n in nodes] == [{**n, "attrs": n["attrs"] or {}} for n in want], html


def customers_later(spark, tmp_path, name, first, later):
    """Rows by page_id of a query over customers of keys `later`, run after it ran over those of keys `first`, whose pages have the same tags."""
    for keys, k in ((first, "first"), (later, "later")):
        rows = [(i, f"Customer#{i:09}", i % 25, i / 4, "BUILDING") for i in keys]
        spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / k / "customer.parquet"))
        out = __spark_entry__.queries()[name](spark, str(tmp_path / k)).collect()
    assert len(out) == len(later)
    return {r.page_id: r for r in out}


def test_article_density_after_pages_of_the_same_tags(spark, tmp_path):
    out = customers_later(spark, tmp_path, "article_density", range(600), range(2801, 2805))
    for k, r in out.items():
        said = f"The account of Customer#{k:09} in the segment BUILDING was opened long ago and it has since then been kept in good order by its owner"
        body = [said, "Short but within.", f"{said} (again)", *(["More", said] if k % 2 == 0 else [])]
        assert (r.title, r.author, r.date, r.body) == (f"Customer {k}", f"Clerk {k % 25}", f"2024-01-{k % 28 + 1:02}", "\n".join(body))


def test_single_entity_after_pages_of_the_same_tags(spark, tmp_path):
    out = customers_later(spark, tmp_path, "single_entity", range(40), [1000])
    assert tuple(out[1000]) == (1000, "Customer#000001000", 250.0, "BUILDING")


def test_static_enough_after_pages_of_the_same_tags(spark, tmp_path):
    out = customers_later(spark, tmp_path, "static_enough", range(0, 400, 8), [4])
    assert tuple(out[4]) == (4, False, True)


def long_pages():
    import random

    dice = random.Random(5)
    card = lambda i: f'<article class="product-card c{i % 7}"><h2 class="title">Thing {i}</h2><span class="price">${i}.50</span><a class="link" href="/p/{i}">more</a></article>'
    row = lambda i: f"<tr><td>{i}<td><b>n{i}</b><td class='k{i % 3}'>{'<table><tr><td>x</table>' if i % 9 == 4 else ''}"
    yield "<title>T</title><meta name=description content=' d '><body><nav><ul>" + "<li><a href='/n'>n</a>" * 4 + "</ul></nav>" + "".join(map(card, range(60))) + "<h1>late</h1><h3> </h3><title>no</title>"
    yield "<table class=data><thead><tr><th>A<th>B</thead>" + "".join(map(row, range(40))) + "</table>" + "<table><tr><td>1<td>2</table>" * 6
    yield "<div>" + "".join(f"<section class='s'><ul><li>a{i}<li>b{i}<li>c{i}<li class='u{i}'>d</ul><p>t{i}</p><img src=x></section>" for i in range(30)) + "</div><a href='#x'>a</a><a href=' '>b</a><a href='JavaScript:1'>c</a>"
    yield "no tags at all " * 3
    yield "<h1> </h1>" * 40 + "".join(f"<h{i % 3 + 1} class='h'>\u2003{i}  x<i> y</i></h{i % 3 + 1}>" for i in range(120))
    tags = ["div", "p", "ul", "li", "h2", "a href='/a b'", "a", "table", "tr", "td", "section class='card hot'", "span class='x'", "img", "title", "body", "nav", "script"]
    for _ in range(120):
        yield "".join(dice.choice([f"<{dice.choice(tags)}>"] * 4 + [f"</{dice.choice(tags).split()[0]}>"] * 2 + ["t  e ", "\u3000", "$5.00"]) for _ in range(dice.randint(50, 300)))
        own = dice.choice(["<div class='b'><h2>q</h2><p>w</p></div>", "<li class=e><a href=/z>z</a><b>y</b>", "<tr><td>1<td><i>2</i>"])
        yield "<body>" + "<section>" * dice.randint(0, 2) + own * dice.randint(11, 30) + "</section><div><h1>x</h1><p>y<p>z</div>" * dice.randint(0, 14)


def test_analysis_of_the_nodes_that_long_pages_show(spark):
    """What is shown of a long page gives what all of its nodes give, and all of them come back."""
    from pyspark.sql import types as T

    rows, schema = [], T.StructType([T.StructField("page_id", T.LongType()), T.StructField("nodes", dom.NODES), T.StructField("text_length", T.IntegerType())])
    few = 0
    for i, html in enumerate(long_pages()):
        nodes, packed, length = (x.to_pylist()[0] if x.type != "binary" else x for x in dom._long_page(html, False))
        whole = dom._lists([dom.outlined(html)])
        assert dom.unpack(packed[0].as_buffer()).to_pylist() == whole.to_pylist()[0]
        as_row = lambda ns: [tuple(dict(v) if k == "attrs" and v is not None else v for k, v in n.items()) for n in ns]
        rows += [(2 * i, as_row(whole.to_pylist()[0]), None), (2 * i + 1, as_row(nodes), length)]
        few += len(nodes) < len(whole.to_pylist()[0])
    assert few > 40
    empty = "struct<json_ld_types:array<string>,microdata_types:array<string>,payloads:array<struct<json:string>>>"
    pages = spark.createDataFrame(rows, schema).withColumns({"url": F.lit("https://x.example.com/a/"), "markup_length": F.lit(10_000), "embedded": F.from_json(F.lit('{"json_ld_types":[],"microdata_types":[],"payloads":[]}'), empty)})
    from pagemill.plans.runner import sketches

    of = {r.domain: (r.sketch, r.classes) for r in sketches(page.analyze(pages).withColumns({"domain": F.col("page_id").cast("string"), "pattern": F.lit("")})).collect()}
    assert len(of) == len(rows)
    for i in range(0, len(rows), 2):
        assert of[str(i)] == of[str(i + 1)], i


def test_long_pages_whole_and_in_pieces(spark):
    """Of a page above LONG_BYTES few nodes go through Spark, and all of its records come out, in order, whatever the strategy."""
    card = lambda i: f'<article class="c"><h2 class="title">Thing {i}</h2><span class="price">${i}.50</span><a class="url" href="/p/{i}">more</a></article>'
    pages = [(k, f"https://x.example.com/l/{k}", "<body><div>" + "".join(card(i) for i in range(n)) + "</div></body>") for k, n in ((1, 9000), (2, 40), (3, 10_001), (4, 0))]
    assert [len(html) > dom.LONG_BYTES for _, _, html in pages] == [True, False, True, False]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    engine = api.Engine(spark, settings=Settings.of(max_records=0, max_html_bytes=0))
    ready = engine.prepared(df)
    shown = {r.page_id: (r.n, r.packed) for r in ready.select("page_id", F.size("nodes").alias("n"), F.col("packed").isNotNull().alias("packed")).collect()}
    assert shown[1][0] == shown[3][0] < 300 and [shown[k][1] for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert {r.page_id: r.n for r in dom.whole_nodes(ready).select("page_id", F.size("nodes").alias("n")).collect()} == {k: len(dom.parse(html)) for k, _, html in pages}
    out = engine.extract(df, "Extract the title, price and url of all products", options=Options(max_records=None), semantic=False)
    got = sorted((r.page_id, r.row_idx, r.record["title"], r.record["price"], r.record["url"]) for r in out.records.where("page_id <> 4").collect())
    assert got == [(k, i, f"Thing {i}", f"${i}.50", f"https://x.example.com/p/{i}") for k, n in ((1, 9000), (2, 40), (3, 10_001)) for i in range(n)]
    names = [Plan("single_dom_selector", fields=(FieldSelector("title", "article:last-child h2"),)), Plan("visible_text_regex", patterns=(("title", "Thing [0-9]{3,}"),)), Plan("article_extraction")]
    for plan in names:
        rows = {}
        for own in (ready, dom.parse_pages(df.withColumn("embedded", F.lit(None).cast("string")))):
            records, notes = interpreter.run_plans(own.withColumn("plan", F.lit(plan.to_json())), Intent((FieldSpec("title"), FieldSpec("text")), expected="object"))
            rows[len(rows)] = (sorted((r.page_id, r.row_idx, tuple(r.record.items())) for r in records.collect()), sorted((r.page_id, r.notes) for r in notes.collect()))
        assert rows[0] == rows[1]
