"""More queries of page analysis, selectors, embedded data and values, over pages made of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import normalize as norm
from pagemill.functions.embedded import embedded, preview
from pagemill.operators import compliance, css, dom, page, strategies
from pagemill.plans.model import FieldSelector, FieldSpec, Intent, Plan
from pagemill.queries import made, part_pages, query, said, table


def gathered(rows: DataFrame, key: Column, order: list[str], html: Column, sep: str = "") -> DataFrame:
    """(k, body): the HTML of each row, in order, joined by key."""
    parts = F.array_sort(F.collect_list(F.struct(*order, html.alias("html"))))
    return rows.groupBy(key.alias("k")).agg(F.array_join(F.transform(parts, lambda x: x["html"]), sep).alias("body"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: three links of navigation, one that leads nowhere, then a link for each supplier, some to calendars."""
    s = table(spark, sf_dir, "supplier")
    href = F.when(F.col("s_suppkey") % 3 == 0, said("/cal/", F.col("s_suppkey"), ".ics")).otherwise(said("item/", F.col("s_suppkey")))
    body = gathered(s, F.col("s_nationkey"), ["s_suppkey"], said('<p><a href=" ', href, ' "> ', F.col("s_name"), "\n x</a>"))
    nav = '<nav><ul><li><a href="/1">one</a><li><a href="/2">two</a><li><a href="/3">three</a></ul></nav><a href="#top">top</a><a href="JavaScript:x()">x</a><a>none</a>'
    return made(body, "k", said(nav, F.col("body")))


_DUCK_LINK = "case when s_suppkey % 3 = 0 then 'https://shop.example.com/cal/' || s_suppkey || '.ics' else 'https://shop.example.com/item/' || s_suppkey end"


@query(f"select page_id, text, href from (select cast(s_nationkey as bigint) page_id, s_name || ' x' as text, {_DUCK_LINK} href, row_number() over (partition by s_nationkey order by s_suppkey) r from supplier) where r <= 20")
def content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dom.parse_pages(linked_pages(spark, sf_dir))
    return p.select("page_id", F.explode(page.links(F.col("nodes"), F.col("url"))).alias("a")).select("page_id", "a.text", "a.href")


@query(f"""
    with a as (select cast(s_nationkey as bigint) page_id, s_suppkey i, s_name || ' x' as text, {_DUCK_LINK} href from supplier
               union all select distinct cast(s_nationkey as bigint), x.i, x.t, 'https://shop.example.com/' || x.h from supplier, (values (-3, 'one', '1'), (-2, 'two', '2'), (-1, 'three', '3')) x(i, t, h)),
    r as (select *, row_number() over (partition by page_id order by i) k from a)
    select page_id, text, href from r where k <= 80""")
def anchors_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dom.parse_pages(linked_pages(spark, sf_dir))
    return p.select("page_id", F.explode(page.anchors(F.col("nodes"), F.col("url"))).alias("a")).select("page_id", "a.text", "a.href")


@query("""select page_id, href from (select cast(s_nationkey as bigint) page_id, 'https://shop.example.com/cal/' || s_suppkey || '.ics' href, row_number() over (partition by s_nationkey order by s_suppkey) r,
                 k from (select *, row_number() over (partition by s_nationkey order by s_suppkey) k from supplier) where s_suppkey % 3 = 0 and k <= 77) where r <= 5""")
def calendar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dom.parse_pages(linked_pages(spark, sf_dir))
    return p.select("page_id", F.explode(page.calendar_urls(page.anchors(F.col("nodes"), F.col("url")))).alias("href"))


@query("select c_custkey page_id, substr(trim(c_name || ' ' || repeat('wide words ', cast(c_custkey % 90 as int))), 1, 500) description, c_name || ' shop' title from customer")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = said(F.col("c_name"), " ", F.expr("repeat('wide words ', cast(c_custkey % 90 as int))"))
    html = said('<head><title> ', F.col("c_name"), '\n shop</title><meta name="keywords" content="no"><meta name="description" content=" ', content, '"><meta name="description" content="second"></head>')
    p = dom.parse_pages(made(table(spark, sf_dir, "customer"), "c_custkey", html))
    return p.select("page_id", page.meta_description(F.col("nodes")).alias("description"), page.title(F.col("nodes")).alias("title"))


def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation with a heading of one of three levels for each supplier; the same balance class occurs often."""
    s = table(spark, sf_dir, "supplier")
    level = (F.col("s_suppkey") % 3 + 1).cast("string")
    html = said("<h", level, "> Class <i>", F.floor(F.col("s_acctbal") / 400).cast("long"), "</i></h", level, "><h4>no</h4>")
    return made(gathered(s, F.col("s_nationkey"), ["s_suppkey"], html), "k", F.col("body"))


_DUCK_HEADINGS = "h as (select cast(s_nationkey as bigint) page_id, s_suppkey % 3 as level, s_suppkey i, 'Class ' || cast(floor(s_acctbal / 400) as bigint) t from supplier)"


@query(f"with {_DUCK_HEADINGS}, r as (select *, row_number() over (partition by page_id order by level, i) k from h) select page_id, string_agg(t, '|' order by k) headings from r where k <= 30 group by 1")
def headings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dom.parse_pages(heading_pages(spark, sf_dir))
    return p.select("page_id", F.array_join(page.headings(F.col("nodes")), "|").alias("headings"))


@query(f"with {_DUCK_HEADINGS}, f as (select page_id, t, min(level * 1000000000 + i) place from h group by 1, 2), r as (select *, row_number() over (partition by page_id order by place) k from f) select page_id, string_agg(t, '|' order by k) headings from r where k <= 25 group by 1")
def headings_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dom.parse_pages(heading_pages(spark, sf_dir))
    return p.select("page_id", F.array_join(page.distinct_headings(F.col("nodes")), "|").alias("headings"))


@query("""
    with b as (select s_suppkey page_id, unnest([struct_pack(r := 1, t := s_name), struct_pack(r := 2, t := 'Nation number ' || s_nationkey), struct_pack(r := 3, t := 'Balance of ' || cast(s_acctbal as varchar)), struct_pack(r := 4, t := 'Nation number ' || s_nationkey || ' small Balance of ' || cast(s_acctbal as varchar))]) x from supplier)
    select page_id, string_agg(x.t, '|' order by x.r) blocks from b where length(x.t) between 8 and 600 group by 1""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by tag, then in order; short ones and repeated ones are left out."""
    html = said("<section><p>Nation number ", F.col("s_nationkey"), "</p><p>small</p><p>Balance <b>of</b> ", F.col("s_acctbal"), "</p></section><h1>", F.col("s_name"), "</h1><blockquote>Nation  number ", F.col("s_nationkey"), "</blockquote>")
    p = dom.parse_pages(made(table(spark, sf_dir, "supplier"), "s_suppkey", html))
    return p.select("page_id", F.array_join(page.text_blocks(F.col("nodes")), "|").alias("blocks"))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation with two tables of its suppliers: one with headings, and one without that has a second column in rows beyond the fifth."""
    s = table(spark, sf_dir, "supplier")
    one = gathered(s, F.col("s_nationkey"), ["s_suppkey"], said("<tr><td>", F.col("s_suppkey"), "</td><td> ", F.col("s_name"), "</td></tr>"))
    two = gathered(s, F.col("s_nationkey"), ["s_suppkey"], said("<tr><td>n", F.col("s_suppkey")))
    both = one.join(two.select("k", F.col("body").alias("other")), "k")
    return made(both, "k", said("<table><thead><tr><th>Key</th><th>Supplier <i>name</i></th><th></th></tr></thead><tbody>", F.col("body"), "</tbody></table><table>", F.col("other"), "</table>"))


@query("""
    with g as (select cast(s_nationkey as bigint) page_id, count(*) n, list(cast(s_suppkey as varchar) order by s_suppkey) ks, list(s_name order by s_suppkey) ns from supplier group by 1)
    select page_id, 'table:nth(1)' selector, cast(n as int) row_count, 2 col_count, 'Key|Supplier name|' headers, array_to_string([ks[1] || ',' || ns[1], case when n > 1 then ks[2] || ',' || ns[2] end], ';') sample from g
    union all select page_id, 'table:nth(2)', cast(n as int), 1, 'n' || ks[1], array_to_string(['n' || ks[1], case when n > 1 then 'n' || ks[2] end], ';') from g""")
def tables_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dom.parse_pages(table_pages(spark, sf_dir))
    t = p.select("page_id", F.explode(page.tables(F.col("nodes"))).alias("t"))
    sample = F.array_join(F.transform("t.sample_rows", lambda r: F.array_join(r, ",")), ";")
    return t.select("page_id", "t.selector", "t.row_count", "t.col_count", F.array_join("t.headers", "|").alias("headers"), sample.alias("sample"))


@query("""
    with r as (select cast(s_nationkey as bigint) page_id, s_suppkey i, s_name n, s_suppkey % 4 = 0 hot from supplier),
    a as (select page_id, 1 c, i o, 'T ' || n t from r union all select page_id, 2, length(n) * 100000000 + i, 'sale on ' || n from r where hot)
    select page_id, string_agg(t, '|' order by c, o) texts from (select *, row_number() over (partition by page_id order by c, o) k from a) where k <= 500 group by 1""")
def selector_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses one after another: plain, with text (by length), and two that yield nothing."""
    s = table(spark, sf_dir, "supplier")
    html = said('<div class="item x"><h2>T <b>', F.col("s_name"), "</b></h2>", F.when(F.col("s_suppkey") % 4 == 0, said("<p>sale  on ", F.col("s_name"), "</p>")).otherwise("<p>no</p>"), "</div>")
    p = dom.parse_pages(made(gathered(s, F.col("s_nationkey"), ["s_suppkey"], html), "k", F.col("body")))
    found = css.select_all(F.col("nodes"), "div.item > h2, p:contains('sale on'), h2:hover, p:has(b)")
    return p.select("page_id", F.array_join(F.transform(found, lambda n: dom.text_of(F.col("nodes"), n)), "|").alias("texts"))


@query("""
    with r as (select *, row_number() over (partition by s_nationkey order by s_suppkey) k, count(*) over (partition by s_nationkey) n from supplier)
    select cast(s_nationkey as bigint) page_id, string_agg(s_name, '|' order by k) filter (where k % 2 = 1) odd, string_agg(s_name, '|' order by k) filter (where k > 1) later, string_agg(s_name, '|' order by k) filter (where k = n) as last,
           string_agg(s_name, '|' order by k) filter (where s_suppkey % 5 <> 0) plain, string_agg(s_name, '|' order by k) filter (where s_suppkey % 10 = 3) ends from r group by 1""")
def selector_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nth-child, siblings, last-child, :not and attribute tests."""
    s = table(spark, sf_dir, "supplier")
    html = said('<li data-k="k', F.col("s_suppkey"), '"', F.when(F.col("s_suppkey") % 5 == 0, ' class="five z"').otherwise(""), "><b>", F.col("s_name"), "</b></li>")
    p = dom.parse_pages(made(gathered(s, F.col("s_nationkey"), ["s_suppkey"], html), "k", said("<ul>", F.col("body"), "</ul>")))
    text = lambda sel: F.nullif(F.array_join(F.transform(css.select_all(F.col("nodes"), sel, 10**6), lambda n: dom.text_of(F.col("nodes"), n)), "|"), F.lit(""))
    return p.select("page_id", text("ul > li:nth-child(odd)").alias("odd"), text("li + li").alias("later"), text("li:last-child b").alias("last"), text("ul li:not(.five)").alias("plain"), text("li[data-k$='3']").alias("ends"))


@query("select page_id, row_idx, title from (select cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) * 100 + p_size page_id, cast(row_number() over (partition by p_brand, p_size order by p_partkey) - 1 as int) row_idx, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) title from part) where row_idx < 2")
def records_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan("repeated_dom_selector", container="article", fields=(FieldSelector("title", "h2"),))
    found = strategies.execute(dom.parse_pages(part_pages(spark, sf_dir)), plan, Intent((FieldSpec("title"),)), 2)
    return found.select("page_id", "row_idx", F.element_at("record", F.lit("title")).alias("title"))


@query("""
    with g as (select cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) * 100 + p_size page_id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) t, cast(cast(p_retailprice as decimal(12,2)) as varchar) p, row_number() over (partition by p_brand, p_size order by p_partkey) k, count(*) over (partition by p_brand, p_size) n from part)
    select page_id, round(avg(length(t || '$' || p || 'more')) filter (where k <= 10), 6) avg_text_length, string_agg(substr(t || '$' || p || 'more', 1, 200), '|' order by k) filter (where k <= 2) sample from g where n >= 3 group by 1""")
def section_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators import sections

    s = sections.candidate_sections(dom.parse_pages(part_pages(spark, sf_dir))).select("page_id", F.explode("sections").alias("s"))
    return s.select("page_id", F.round("s.avg_text_length", 6).alias("avg_text_length"), F.array_join("s.sample_texts", "|").alias("sample"))


def embedding_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with Twitter cards, microdata, hydration payloads and flags, some with and some without."""
    k, name = F.col("p_partkey"), F.col("p_name")
    some = lambda n, text: F.when(k % n == 0, text).otherwise("")
    payload = said('{"pad":"', F.expr("repeat('x', cast(p_partkey % 4 as int) * 900)"), '","id":', k, "}")
    html = said(
        '<meta property="og:title" content="first"><meta property="og:title" content="', name, '"><meta name="twitter:card" content="summary"><meta name="twitter:title" content="', name, '">',
        some(2, F.lit('<div itemscope itemtype="https://schema.org/Product"></div><div itemtype="http://schema.org/Offer"></div><i itemtype="https://schema.org/Product"></i>')),
        some(3, said('<script id="__NEXT_DATA__" type="application/json">', payload, "</script>")), some(5, F.lit("<script>window.__NUXT__={}</script>")), some(7, F.lit("<script>window.__INITIAL_STATE__ = 1</script>")), some(11, F.lit('<script type="application/ld+json">{bad</script>')),
    )
    return made(table(spark, sf_dir, "part"), "p_partkey", html).withColumn("embedded", embedded(F.col("html")))


@query("""
    select p_partkey page_id, p_name og_title, 'summary' card, p_name twitter_title, case when p_partkey % 2 = 0 then 'Offer,Product' else '' end microdata, p_partkey % 3 = 0 next_data, p_partkey % 5 = 0 nuxt, p_partkey % 7 = 0 initial_state,
           case when p_partkey % 3 = 0 then cast(p_partkey as varchar) end payload_id,
           case when p_partkey % 3 = 0 then case when length('{"pad":"","id":}') + 900 * (p_partkey % 4) + length(cast(p_partkey as varchar)) > 2048 then 'truncated' else 'whole' end end shown from part""")
def embedded_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedded")
    get = lambda m, key: F.element_at(e[m], F.lit(key))
    payload = F.get(e["payloads"], F.lit(0))["json"]
    shown = F.when(F.get_json_object(preview(payload), "$.truncated") == "true", "truncated").when(payload.isNotNull(), "whole")
    return embedding_pages(spark, sf_dir).select(
        "page_id", get("open_graph", "og:title").alias("og_title"), get("twitter", "twitter:card").alias("card"), get("twitter", "twitter:title").alias("twitter_title"), F.array_join(e["microdata_types"], ",").alias("microdata"),
        e["next_data_present"].alias("next_data"), e["nuxt_present"].alias("nuxt"), e["initial_state_present"].alias("initial_state"), F.get_json_object(payload, "$.id").alias("payload_id"), shown.alias("shown"),
    )


@query("""
    select p_partkey page_id, case p_partkey % 9 when 0 then 'article' when 1 then 'product_detail' when 2 then 'product_listing' when 3 then 'job_listing' when 4 then 'table_page' when 5 then 'directory_listing' when 6 then 'search_results' when 7 then 'article' else 'generic_content' end page_type,
           p_partkey % 9 in (2, 4, 5, 6) sections from part""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each kind: by JSON-LD or microdata, tables, repeated cards, or the length of its text."""
    k = F.col("p_partkey") % 9
    linked = lambda t: F.lit(f'<script type="application/ld+json">{{"@type":"{t}"}}</script>')
    cards = lambda n: F.lit("<main>" + "".join(f"<section class=card><h2>Thing {i}</h2><a href=/{i}>see {i}</a></section>" for i in range(n)) + "</main>")
    body = (
        F.when(k == 0, linked("NewsArticle")).when(k == 1, linked("Product")).when(k == 2, F.concat(F.lit('<div itemtype="https://schema.org/Product"></div>'), cards(3))).when(k == 3, linked("JobPosting"))
        .when(k == 4, F.lit("<table>" + "<tr><td>a<td>b" * 7 + "</table>")).when(k == 5, cards(5)).when(k == 6, cards(4)).when(k == 7, F.lit("<p>" + "long text " * 301)).otherwise(F.lit("<p>short"))
    )
    p = made(table(spark, sf_dir, "part"), "p_partkey", said("<body>", body)).withColumns({"markup_length": F.length("html"), "embedded": embedded(F.col("html"))})
    c = page.analyze(dom.parse_pages(p)).select("page_id", "compact")
    return c.select("page_id", F.col("compact.page_type_hint").alias("page_type"), (F.size("compact.candidate_sections") > 0).alias("sections"))


@query("""
    with p as (select c_custkey i, c_custkey % 8 k from customer)
    select i page_id, k >= 4 and k % 2 = 1 and k <> 7 and k <> 5 enough_for_array, k >= 4 and k <> 7 enough_for_object from p""")
def static_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts (k of 4 and more) are enough for one object, and for a list only with a table or cards that speak of the field; an empty shell with hydration data (k = 7) is not."""
    k = F.col("c_custkey") % 8
    # k = 5 has a table, but nothing that speaks of the field
    words = F.when(k >= 4, F.lit("plain words " * 100)).otherwise("few")
    body = said("<h1>", F.when(k == 5, "Other").otherwise("Unit price"), "</h1><p>", words, "</p>", F.when(k % 2 == 1, F.lit("<table><tr><th>a<tr><td>1</table>")).otherwise(""), F.when(k == 7, F.concat(F.lit('<script id="__NEXT_DATA__">{}</script><!--'), F.lit("x" * 30_000), F.lit("-->"))).otherwise(""))
    p = made(table(spark, sf_dir, "customer"), "c_custkey", said("<body>", body)).withColumns({"markup_length": F.length("html"), "embedded": embedded(F.col("html"))})
    p = page.analyze(dom.parse_pages(p))
    enough = lambda expected: page.static_is_enough(F.col("compact"), F.col("embedded"), expected, ["unit_price"])
    return p.select("page_id", enough("array").alias("enough_for_array"), enough("object").alias("enough_for_object"))


@query("""
    select s_suppkey page_id, '## URL' || chr(10) || 'https://shop.example.com/' || s_suppkey || chr(10) || chr(10) || '## Title' || chr(10) || s_name || chr(10) || chr(10) || '## Headings' || chr(10) || '- ' || s_name || chr(10) || chr(10) || '## Pairs' || chr(10) || '- Nation: ' || s_nationkey || chr(10) || '- Balance: ' || cast(s_acctbal as varchar) || chr(10) || chr(10)
           || '## Links' || chr(10) || '- dates -> https://shop.example.com/a.ics' || chr(10) || chr(10) || '## Calendars' || chr(10) || '- https://shop.example.com/a.ics' || chr(10) || chr(10) || '## Text' || chr(10) || '- ' || s_name bundle from supplier""")
def facts_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = said("<title>", F.col("s_name"), "</title><h1>", F.col("s_name"), "</h1><dl><dt>Nation<dd>", F.col("s_nationkey"), "</dl><table><tr><td>Balance<td>", F.col("s_acctbal"), "</table><a href='a.ics'>dates</a>")
    p = dom.parse_pages(made(table(spark, sf_dir, "supplier"), "s_suppkey", html).withColumn("embedded", F.lit(None).cast("string")))
    bundle = page.facts(F.col("nodes"), F.col("url"), F.struct(F.col("embedded")))
    p = p.select("page_id", bundle.alias("facts")).withColumn("facts", F.col("facts").withField("structured_data_compact", F.lit(None).cast("string")))
    return p.select("page_id", page.facts_text(F.col("facts")).alias("bundle"))


@query("""
    select c_custkey page_id, c_name title, case when c_custkey % 2 = 0 then 'Author ' || c_custkey end author, '2024-0' || (c_custkey % 9 + 1) || '-15' as date, c_mktsegment summary, 'First of ' || c_name || chr(10) || 'Second' as body from customer""")
def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's heading, metadata and paragraphs, without navigation and advertisements, under other names for them."""
    k = F.col("c_custkey")
    html = said(
        "<head><title>t</title>", F.when(k % 2 == 0, said('<meta name="author" content="Author ', k, '">')).otherwise(""), '<meta property="article:published_time" content="2024-0', (k % 9 + 1), '-15T08:00:00Z"><meta name="description" content="', F.col("c_mktsegment"), '"></head><body><p>outside</p><article><h1>',
        F.col("c_name"), "</h1><nav><p>menu</p></nav><p>First  of ", F.col("c_name"), '</p><div class="big ad"><p>buy</p></div><p></p><p>Second</p><aside><p>aside</p></aside></article></body>',
    )
    intent = Intent((FieldSpec("title"), FieldSpec("author"), FieldSpec("publish_date", "date"), FieldSpec("summary"), FieldSpec("body"), FieldSpec("price")), expected="object")
    found = strategies.execute(dom.parse_pages(made(table(spark, sf_dir, "customer"), "c_custkey", html)), Plan("article_extraction"), intent)
    get = lambda n: F.element_at("record", F.lit(n))
    return found.select("page_id", get("title").alias("title"), get("author").alias("author"), get("publish_date").alias("date"), get("summary").alias("summary"), get("body").alias("body"))


# --- Values ------------------------------------------------------------------------------------------------------------


@query("""
    select o_orderkey, (o_orderkey % 100) / 10.0 comma, case when o_orderkey % 3 > 0 then o_orderkey end maybe, strftime(o_orderdate, '%Y-%m-%d') fuzzy, strftime(o_orderdate, '%Y-%m-%d') slashed, o_orderpriority as nothing, case o_orderkey % 3 when 0 then true when 1 then false end flag,
           'https://x.example.com/o/' || o_orderkey link, 'a' || o_orderkey || '@x.org' mail, case when o_orderkey % 2 = 0 then 'tel 030 1234567' end is_null from orders""")
def norm_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma numbers, values that are none, and dates in other words."""
    k, n, day = F.col("o_orderkey"), norm.normalize, F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", norm.number(said("about ", F.floor((k % 100) / 10).cast("long"), ",", (k % 10).cast("int"), " kg")).alias("comma"), norm.integer(F.when(k % 3 > 0, said("no. ", k)).otherwise("none")).alias("maybe"),
        norm.date(said("sent on the ", F.date_format(day, "d"), " of ", F.date_format(day, "MMMM yyyy"), " by post")).alias("fuzzy"), norm.date(F.date_format(day, "MM/dd/yyyy")).alias("slashed"), n(F.col("o_orderpriority"), "currency").alias("nothing"),
        norm.boolean(F.when(k % 3 == 0, " YES ").when(k % 3 == 1, "Unavailable").otherwise("perhaps")).alias("flag"), n(said("../o/", k), "url", F.lit("https://x.example.com/a/b")).alias("link"), n(said("write to a", k, "@x.org today"), "email").alias("mail"),
        F.when(k % 2 == 0, F.coalesce(n(F.lit("12345"), "phone"), F.lit("tel 030 1234567"))).alias("is_null"),
    )


_VALUES = [("1,5", "number"), ("1,234.5", "number"), ("-3e2", "number"), ("x", "number"), ("12", "integer"), ("1.0", "integer"), ("$3", "currency"), ("free", "currency"), ("http:x", "url"), ("ftp://x", "url"), ("a@b.co", "email"), ("a@b", "email"), ("+49 30 123456", "phone"), ("123", "phone"), ("3rd March 2021", "date"), ("soon", "date"), ("No", "boolean"), ("maybe", "boolean"), ("t", "string"), ("a; b", "list_string"), (" ", "string")]
_RIGHT = [True, False, True, False, True, False, True, False, True, False, True, False, True, False, True, False, True, False, True, True, True]


@query(f"select v as value, k as kind, ok as parses, trim(v) <> '' present, case when k = 'url' then false when k = 'boolean' then lower(v) in ('true', 'false', 'yes', 'no', '0', '1') else trim(v) <> '' end plausible, count(*) n from orders, (values {', '.join(f"('{v}', '{k}', {ok})" for (v, k), ok in zip(_VALUES, _RIGHT, strict=True))}) x(v, k, ok) group by 1, 2, 3, 4, 5")
def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values are one of their type, are there, and may be merged."""
    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.lit(k).alias("kind")) for v, k in _VALUES))).alias("x")).select("x.value", "x.kind")
    rows = rows.groupBy("value", "kind").agg(F.count("*").alias("n"))
    value = F.col("value")
    by_kind = lambda f: F.coalesce(*(F.when(F.col("kind") == k, f(k)) for k in norm.TYPES))
    return rows.select("value", "kind", "n", by_kind(lambda k: norm.parses_as(value, k, fuzzy_dates=True)).alias("parses"), norm.present(value).alias("present"), by_kind(lambda k: norm.plausible(value, k)).alias("plausible"))


@query("""
    with v as (select o_orderkey, o_orderkey % 2 k, 'http://x.example.com/' || o_orderkey u, case when o_orderkey % 3 = 0 then 'aa; b' else 'a; b; cccc' end l from orders)
    select o_orderkey, u as url, case when o_orderkey % 3 = 0 then 'aa; b' when k = 0 then 'a; b; c' else 'a; b; cccc' end list, case when k = 0 then 'yes' else 'no' end as flag, case when k = 0 then 'kept' end text from v""")
def picked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two values a merge takes: plausible ones, the semantic one for URLs, else the shortest; lists by the length of their parts."""
    k = F.col("o_orderkey")
    odd = k % 2 == 1
    listed = F.when(k % 3 == 0, "aa; b").otherwise("a; b; cccc")
    pick = norm.pick_field
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(F.lit("http://y.example.com/"), said("http://x.example.com/", k), "url").alias("url"), pick(listed, F.when(odd, "dddddddd; e").otherwise(F.when(k % 3 == 0, "cccc").otherwise("a; b; c")), "list_string").alias("list"),
        pick(F.when(odd, "no").otherwise("perhaps"), F.when(odd, "well, no").otherwise("yes"), "boolean").alias("flag"), pick(F.lit("  "), F.when(~odd, "kept"), "string").alias("text"),
    )


# --- Compliance ----------------------------------------------------------------------------------------------------------


@query("""select s_suppkey, s_suppkey % 4 = 0 public, s_suppkey % 5 <> 1 html, case when s_suppkey % 3 = 2 then 'no_robots' when s_suppkey % 3 = 0 and s_suppkey % 7 < 3 then 'disallowed' else 'allowed' end robots from supplier""")
def fetch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public addresses, content types and robots.txt rules of hosts."""
    k = F.col("s_suppkey")
    low = (k % 200 + 1).cast("int")
    ips = F.when(k % 4 == 0, F.array(said("8.8.4.", low))).when(k % 4 == 1, F.array(said("10.0.0.", low))).when(k % 4 == 2, F.array(said("93.184.0.", low), F.lit("127.0.0.1"))).otherwise(F.array(F.lit("fe80::1")))
    kind = F.when(k % 5 == 0, "text/html; charset=utf-8").when(k % 5 == 1, "image/png").when(k % 5 == 2, " Application/XHTML+xml").when(k % 5 == 3, F.lit(None).cast("string")).otherwise("text/xml")
    host = said("h", k % 3)
    path = F.when(k % 7 < 3, said("/private/", k)).otherwise(said("/open/", k))
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", compliance.host_allowed(ips).alias("public"), compliance.is_html(kind).alias("html"), host.alias("host"), F.concat(F.lit("https://"), host, path).alias("canonical"))
    robots = spark.createDataFrame([("h0", "User-agent: *\nDisallow: /private/"), ("h1", "User-agent: other\nDisallow: /")], "host string, rules string")
    return compliance.robots_verdict(pages, robots, "pagemill").select("s_suppkey", "public", "html", "robots")
