"""Queries of plans as rows, compacted stores, keyed state and fetching, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import api
from pagemill.functions.embedded import embedded
from pagemill.operators import dom, interpreter, strategies
from pagemill.operators.staging import spread, staged
from pagemill.plans.model import FieldSelector, FieldSpec, Intent, Options, Plan
from pagemill.queries import query, said, table
from pagemill.queries_jobs import WHOLE, _drained, _folder, _stored
from pagemill.settings import Settings
from pagemill.sources import fetching
from pagemill.sources.store import Store
from pagemill.streaming import state

ASK = "Extract the title, price and url of all products"
_CARD_SQL = "trim(regexp_replace(p_name, '\\s+', ' ', 'g')) title, '$' || cast(cast(p_retailprice as decimal(12,2)) as varchar) price"


def _brand() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each brand and size of the parts; each brand is a site of its own, whose markup has names of its own."""
    b = _brand().cast("string")
    card = said('<article class="c', b, '"><h2 class="title', b, '">', F.col("p_name"), '</h2><span class="price', b, '">$', F.col("p_retailprice").cast("decimal(12,2)"), '</span><a class="url', b, '" href="/part/', F.col("p_partkey"), '">more</a></article>')
    rows = table(spark, sf_dir, "part").groupBy(_brand().alias("b"), "p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("h")))), lambda x: x["h"]), "").alias("body"))
    return rows.select((F.col("b") * 100 + F.col("p_size")).alias("page_id"), said("https://brand", F.col("b"), ".com/list/", F.col("p_size")).alias("url"), said('<html><body><div class="grid">', F.col("body"), "</div></body></html>").alias("html"))


def _plan_of(b: str) -> Column:
    """The plan of a brand's pages, as a value made of its number."""
    plan = Plan("repeated_dom_selector", container="article.c@", fields=(FieldSelector("title", ".title@"), FieldSelector("price", ".price@"), FieldSelector("url", "a.url@", "href")))
    return F.replace(F.lit(plan.to_json()), F.lit("@"), F.col(b).cast("string"))


@query(f"select cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) * 100 + p_size page_id, {_CARD_SQL}, 'https://brand' || regexp_extract(p_brand, '(\\d+)', 1) || '.com/part/' || p_partkey url from part")
def plans_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page brings its plan; one pass runs all of them."""
    intent = Intent((FieldSpec("title", "string", True), FieldSpec("price", "currency"), FieldSpec("url", "url")))
    pages = _layouts(spark, sf_dir).withColumn("b", F.floor(F.col("page_id") / 100)).withColumn("plan", _plan_of("b")).withColumn("embedded", embedded(F.col("html")))
    records, _ = interpreter.run_plans(dom.parse_pages(pages), intent, present={"repeated_dom_selector"})
    return records.select("page_id", *(F.element_at("record", F.lit(n)).alias(n) for n in ("title", "price", "url")))


@query(f"select cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) * 100 + p_size page_id, {_CARD_SQL}, 'https://brand' || regexp_extract(p_brand, '(\\d+)', 1) || '.com/part/' || p_partkey url from part where p_size = 1 union all select cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) * 100 + p_size + 1000000, {_CARD_SQL}, 'https://brand' || regexp_extract(p_brand, '(\\d+)', 1) || '.com/part/' || p_partkey from part where p_size <> 1 and p_brand in (select p_brand from part where p_size = 1)")
def engine_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's first page is planned (here by what its brand is known to look like); its other pages, later, are served by the template. Records of both runs; those by template have a million added to their page_id."""
    store = Store(spark, _folder(spark, "engine"))
    store.migrate()
    pages = staged(_layouts(spark, sf_dir))
    first = pages.where("page_id % 100 = 1")

    class Known(api.RuleBackend):
        in_tasks = True

        def plan(self, intent, compact, classes):  # noqa: ANN001, ANN202
            b = next(c for c in classes if c.startswith("title"))[5:]
            return Plan("repeated_dom_selector", container=f"article.c{b}", fields=(FieldSelector("title", f".title{b}"), FieldSelector("price", f".price{b}"), FieldSelector("url", f"a.url{b}", "href")))

    engine, options = api.Engine(spark, Known(), store=store, settings=WHOLE), Options(max_records=None)
    cold = engine.extract(first, ASK, options=options, semantic=False)
    sites = first.select(F.floor(F.col("page_id") / 100).alias("b"))
    rest = pages.where("page_id % 100 <> 1").withColumn("b", F.floor(F.col("page_id") / 100)).join(sites, "b", "left_semi").drop("b")
    warm = engine.extract(rest, ASK, options=options, semantic=False)
    served = warm.jobs.where("diagnostics.template_used").select("page_id")
    later = warm.table().join(served, "page_id", "left_semi").withColumn("page_id", F.col("page_id") + 1_000_000)
    return cold.table().unionByName(later).select("page_id", "title", "price", "url")


@query("""
    with k as (select 'key' || o_orderkey % 500 k, max(case when o_orderkey % 11 <> 0 then 1 else 0 end) x from orders group by 1)
    select k idempotency_key, count(*) n, count(distinct 'j' || o_orderkey) ids from k join orders on 'key' || o_orderkey % 500 = k where k in ('key1', 'key77', 'key499') group by 1""")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by key from a store that was compacted and then appended to: only the keys' buckets are opened."""
    store = _stored(spark, sf_dir)
    store.compact("jobs")
    store.append("jobs", store.table("jobs").where("idempotency_key = 'key77'"))  # the same versions again change nothing
    keys = spark.createDataFrame([("key1",), ("key77",), ("key499",), ("nobody",)], "k string")
    return store.lookup("jobs", "idempotency_key", keys).groupBy("idempotency_key").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


_RATE, _BURST, _WAIT = 1 / 3600, 3, 600.0


@query(f"""
    with recursive e as materialized (select user_id, event_id, epoch_us(ts) / 1e6 t, row_number() over (partition by user_id order by ts, event_id) i from events where ts is not null and user_id is not null),
    f(user_id, i, event_id, t, tokens, free, start) as (
        select user_id, i, event_id, t, {_BURST}.0::double - 1, t, t from e where i = 1
        union all
        select user_id, i, event_id, t, case when k >= 1 then k - 1 when turn + (1 - k) / {_RATE!r} > t + {_WAIT} then k else 0 end, case when k >= 1 or turn + (1 - k) / {_RATE!r} > t + {_WAIT} then turn else turn + (1 - k) / {_RATE!r} end,
               case when k >= 1 then turn when turn + (1 - k) / {_RATE!r} > t + {_WAIT} then null else turn + (1 - k) / {_RATE!r} end
        from (select e.user_id, e.i, e.event_id, e.t, greatest(e.t, f.free) turn, least({_BURST}.0::double, f.tokens + (greatest(e.t, f.free) - f.free) * {_RATE!r}) k from f join e on e.user_id = f.user_id and e.i = f.i + 1))
    select event_id, round(start, 2) start, start is null given_up from f""")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of a stream's arrivals under token buckets kept in state; an arrival that gives up takes no token."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    try:
        e = table(spark, sf_dir, "events").where("ts is not null and user_id is not null").select(F.col("user_id").cast("string").alias("domain"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"))
        path = _folder(spark, "arrivals")
        e.write.parquet(path)
        # what drives the watermark past all other arrivals
        e.agg(F.max("at").alias("at")).where("at is not null").select(F.lit("end").alias("domain"), (F.col("at") + F.expr("interval 30 days")).alias("at"), F.lit(-1).cast("long").alias("seq")).write.mode("append").parquet(path)
        stream = spark.readStream.schema(e.schema).parquet(path)
        out = _drained(state.rate_limited(stream, rate=_RATE, burst=_BURST, wait=_WAIT), "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.where("domain <> 'end'").select(F.col("seq").alias("event_id"), F.round("start", 2).alias("start"), "given_up")


@query("""
    select c_custkey page_id, case when c_custkey % 11 = 0 then 'invalid_url' when c_nationkey = 3 then 'blocked_target' when c_nationkey = 4 then 'dns' when c_nationkey = 5 and c_custkey % 2 = 0 then 'blocked_by_robots' when c_custkey % 7 = 0 then 'unsupported_content_type' end error,
           case when c_custkey % 11 = 0 or c_nationkey in (3, 4) or (c_nationkey = 5 and c_custkey % 2 = 0) or c_custkey % 7 = 0 then null else '<p>' || c_custkey || '</p>' end html
    from customer""")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each customer's URL on its nation's host, through addresses, robots rules, rates and content types; the network is made up."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    urls = c.select(k.alias("page_id"), F.when(k % 11 == 0, said("mailto:", k)).otherwise(said("https://n", F.col("c_nationkey"), ".com/", F.when(k % 2 == 0, "even/").otherwise("odd/"), k)).alias("url"))

    def resolve(host: str) -> list[str]:
        if host == "n4.com":
            raise OSError("no such host")
        return ["127.0.0.1"] if host == "n3.com" else ["93.184.216.34"]

    def robots(url: str) -> str | None:
        return "User-agent: *\nDisallow: /even/" if "//n5.com" in url else None

    def fetch(url: str, seconds: float) -> tuple:
        key = int(url.rsplit("/", 1)[1])
        return url, 200, "image/png" if key % 7 == 0 else "text/html", f"<p>{key}</p>".encode(), None

    out = fetching.fetch_pages(urls, Settings.of(rate_per_second=1e9, rate_burst=1000, job_deadline_seconds=1e6), fetch=fetch, resolve=resolve, robots=robots)
    return out.select("page_id", "error", "html")


_LONG = "The account of {n} in the segment {s} was opened long ago and it has since then been kept in good order by its owner"


@query("""
    select c_custkey page_id, 'Customer ' || c_custkey title, 'Clerk ' || c_nationkey author, '2024-01-' || lpad(cast(c_custkey % 28 + 1 as varchar), 2, '0') date,
           x || chr(10) || 'Short but within.' || chr(10) || x || ' (again)' || case when c_custkey % 2 = 0 then chr(10) || 'More' || chr(10) || x else '' end body
    from (select *, 'The account of ' || c_name || ' in the segment ' || c_mktsegment || ' was opened long ago and it has since then been kept in good order by its owner' x from customer)""")
def article_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of pages that mark none: navigation, lists of links, comments and adverts around the text of each customer's page."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    head, tail = _LONG.split("{n}")
    x = said(head, F.col("c_name"), tail.split("{s}")[0], F.col("c_mktsegment"), tail.split("{s}")[1])
    links = "<ul>" + "".join(f'<li><a href="/{i}">Another page with a long title that says a lot about number {i} and more</a></li>' for i in range(5)) + "</ul>"
    body = [
        "<html><body><nav>", links, '</nav><div class="head"><h1>Customer ', k, '</h1><span class="byline">By Clerk ', F.col("c_nationkey"), '</span><time datetime="2024-01-', F.lpad((k % 28 + 1).cast("string"), 2, "0"), '">then</time></div>',
        '<div class="post"><p>', x, "</p><p>Short but within.</p><p>", x, " (again)</p>", F.when(k % 2 == 0, said("<h2>More</h2><div>", x, "</div>")).otherwise(""), '<div class="ad-banner"><p>Buy now what everybody buys because it is so cheap today and only today</p></div></div>',
        links, '<div id="comments"><p>', x, " said one</p><p>", x, " said two</p><p>", x, " said three</p><p>", x, " said four</p></div><p>Imprint</p></body></html>",
    ]
    pages = dom.parse_pages(spread(c, "c_custkey").select(k.alias("page_id"), F.lit("https://x.example.com/").alias("url"), said(*body).alias("html")))
    own = strategies.article(F.col("nodes"))
    return pages.select("page_id", own["title"].alias("title"), own["author"].alias("author"), own["date"].alias("date"), own["text"].alias("body"))
