"""More queries of jobs, templates, merging, stores, output, streams and the engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import api, streaming
from pagemill.functions import text as txt
from pagemill.operators import jobs, merge, metrics, strategies, templates, validate
from pagemill.operators.staging import staged
from pagemill.plans.model import FieldSelector, FieldSpec, Intent, Options, Plan
from pagemill.queries import _DUCK_VISIBLE, _duck_text, part_pages, query, said, table
from pagemill.settings import Settings
from pagemill.sources import artifacts, export
from pagemill.sources.store import Store


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that executors share; where none is named, below the session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- Scores, labels, coverage ---------------------------------------------------------------------------------------------


@query("""
    with r as (select o_orderkey, o_orderkey % 3 = 0 good, cast(o_orderkey % 4 as bigint) n, round((o_orderkey % 7) / 10.0, 1) s, round((o_orderkey % 5) / 10.0, 1) m from orders)
    select o_orderkey, case when good then 'success' when n > 0 or s >= 0.3 then 'partial_success' else 'failed' end status, case when m > s then 'semantic_extraction' else 'table_extraction' end strategy from r""")
def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    score = lambda n: F.round((k % n) / 10, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", validate.response_status(k % 3 == 0, k % 4, score(7)).alias("status"), merge.strategy_label(score(5), score(7), F.lit("table_extraction")).alias("strategy"))


@query("""
    with l as (select l_orderkey page_id, l_partkey % 3 > 0 a, l_partkey % 2 = 0 b from lineitem where l_partkey % 3 > 0 or l_partkey % 2 = 0),
    s as (select page_id, 'name' field, count(*) filter (where a) hits, count(*) filter (where not a) misses from l group by 1 union all select page_id, 'qty', count(*) filter (where b), count(*) filter (where not b) from l group by 1)
    select page_id, field, hits, misses, cast(0 as bigint) errors, round(hits / (hits + misses), 8) coverage from s""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of fields over the records of a page, and the share that has them."""
    p = F.col("l_partkey")
    some = lambda name, here: F.struct(F.lit(name).alias("f"), here.alias("h"))
    fields = F.array(some("name", p % 3 > 0), some("qty", p % 2 == 0))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.transform(F.filter(fields, lambda x: x["h"]), lambda x: x["f"]).alias("hits"), F.transform(F.filter(fields, lambda x: ~x["h"]), lambda x: x["f"]).alias("misses")).where("size(hits) > 0")
    return validate.field_coverage(strategies.field_stats(rows)).withColumn("coverage", F.round("coverage", 8))


@query("""
    with a as (select o_custkey job_id, min(o_orderkey) k from orders group by 1)
    select job_id, case when k % 2 = 0 then 'A' || k else 'B' || k end as name, cast(k as double) qty from a""")
def merge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an object only the first record of each pass counts."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.min("o_orderkey").alias("k"))
    k = F.col("k")
    record = lambda name, qty: F.map_filter(F.create_map(F.lit("name"), name, F.lit("qty"), qty), lambda _, v: v.isNotNull())
    row = lambda i, name, qty: first.select("job_id", F.lit(i).alias("row_idx"), record(name, qty).alias("record"))
    none = F.lit(None).cast("string")
    standard = row(0, F.when(k % 2 == 0, said("A", k)), none).unionByName(row(1, F.lit("later"), F.lit("9")))
    semantic = row(0, said("B", k), k.cast("string")).unionByName(row(1, F.lit("l"), F.lit("1")))
    out = merge.merge_records(standard.where("size(record) > 0"), semantic, Intent((FieldSpec("name"), FieldSpec("qty", "number")), expected="object"))
    return out.select("job_id", F.element_at("record", F.lit("name")).alias("name"), F.element_at("record", F.lit("qty")).cast("double").alias("qty"))


@query("select page_id, title, price, stock, cast(n as bigint) n, tags from (select p_partkey page_id, p_name title, cast(cast(p_retailprice as decimal(12,2)) as double) price, p_size % 2 = 0 stock, p_size n, p_brand || '/' || p_size tags from part)")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a table with the types of their intent."""
    cell = {"title": F.col("p_name"), "price": F.col("p_retailprice").cast("decimal(12,2)").cast("string"), "stock": (F.col("p_size") % 2 == 0).cast("string"), "n": F.col("p_size").cast("string"), "tags": F.concat_ws("; ", "p_brand", F.col("p_size").cast("string"))}
    record = F.create_map(*(x for k, v in cell.items() for x in (F.lit(k), v)))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("row_idx"), record.alias("record"))
    intent = Intent((FieldSpec("title"), FieldSpec("price", "number"), FieldSpec("stock", "boolean"), FieldSpec("n", "integer"), FieldSpec("tags", "list_string")))
    out = api.Result(rows, rows, intent, None, 0).table()
    return out.select("page_id", "title", "price", "stock", "n", F.array_join("tags", "/").alias("tags"))


@query("select cast(0 as bigint) n")
def nothing_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy that marks a failure gives no records."""
    found = strategies.execute(part_pages(spark, sf_dir), Plan("manual_fallback_failed"), Intent((FieldSpec("title"),)))
    return found.agg(F.count("*").alias("n"))


# --- Metrics, limits, deadlines -------------------------------------------------------------------------------------------


@query("select user_id, sum(value) total from events where event_type like 'p%' and value is not null group by 1")
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the counters of a prefix, for each job."""
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.col("event_type").alias("name"), "value")
    return metrics.counter_total(e, "p", by="user_id")


@query("""
    with e as (select event_id, user_id, epoch(ts) t, row_number() over (partition by user_id order by epoch(ts), event_id) - 1 i from events),
    s as (select event_id, t, greatest(t, coalesce(max(t - i * 3600.0) over (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding) + i * 3600.0 - 2 * 3600.0, t)) s from e)
    select event_id, round(s, 3) start, s - t > 600 given_up, round(least(greatest(s + 900 - t, 0), 1200), 3) left_over from s""")
def rate_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts under a bucket of three tokens, which are given up after a wait, and what is left of a budget."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("domain"), F.expr("unix_micros(cast(ts as timestamp)) / 1e6").alias("at"), F.col("event_id").alias("seq"))
    out = jobs.rate_schedule(e, rate=1 / 3600, burst=3, wait=600.0)
    return out.select("event_id", F.round("start", 3).alias("start"), "given_up", F.round(jobs.remaining(F.col("start") + 900, F.col("at"), 1200.0), 3).alias("left_over"))


# --- Stores and output -----------------------------------------------------------------------------------------------------


def _job_rows(spark: SparkSession, sf_dir: str, status: str | None) -> DataFrame:
    """Jobs of orders: first all running, then those of even keys with their end."""
    k = F.col("o_orderkey")
    own = {"id": said("j", k), "url": said("https://shop.example.com/", k), "domain": F.lit("example.com"), "idempotency_key": said("key", k % 500), "status": F.lit("running") if status is None else F.when(k % 4 == 0, status).otherwise("failed"), "quality_score": (k % 10) / 10.0}
    own |= {"created_at": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey)"), "updated_at": F.lit("2024-02-01 00:00:00" if status is None else "2024-02-02 00:00:00")}
    columns = [c.split() for c in jobs.JOBS.split(", ")]
    rows = table(spark, sf_dir, "orders") if status is None else table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    return rows.select(*(own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in columns))


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, _folder(spark, "store"))
    store.migrate()
    store.append("jobs", _job_rows(spark, sf_dir, None))
    store.append("jobs", _job_rows(spark, sf_dir, "success"))
    line = table(spark, sf_dir, "lineitem")
    result = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    at = F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, l_linenumber)")
    store.append("results", result.select(said("r", F.col("l_orderkey"), "-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("id"), said("j", F.col("l_orderkey")).alias("job_id"), F.to_json(F.array(F.col("p"))).alias("records"), F.to_json(F.struct(F.col("p").alias("part"))).alias("diagnostics"), at.alias("created_at")))
    return store


@query("""
    with r as (select l_orderkey, max_by(p, l_linenumber) p from (select l_orderkey, l_linenumber, max(l_partkey) p from lineitem group by 1, 2) group by 1)
    select 'j' || o_orderkey id, case when o_orderkey % 4 = 0 then 'success' when o_orderkey % 2 = 0 then 'failed' else 'running' end status, '[' || p || ']' records, p part from orders left join r on o_orderkey = l_orderkey""")
def stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as their last version has them, with their latest result, from the store's files."""
    store = _stored(spark, sf_dir)
    out = jobs.with_results(store.table("jobs"), store.table("results"))
    return out.select("id", "status", "records", F.get_json_object("diagnostics", "$.part").cast("long").alias("part"))


@query("""
    select 'key' || k idempotency_key, 'j' || last cached_job_id from (select k, max(o_orderkey) filter (where o_orderkey % 4 = 0) as last from (select o_orderkey, o_orderkey % 500 k from orders) group by 1)""")
def stored_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each request the latest job that answered it, or null."""
    store = _stored(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").select(said("key", F.col("o_orderkey") % 500).alias("idempotency_key")).distinct()
    return jobs.finished(asked, store.table("jobs"))


@query("select 'j' || o_orderkey id, 'https://shop.example.com/' || o_orderkey url from orders where o_orderkey % 97 = 0")
def stored_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by id: the filter reaches the store's files."""
    store = _stored(spark, sf_dir)
    return store.by_id("jobs", table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").select(said("j", F.col("o_orderkey")).alias("id"))).select("id", "url")


@query("select cast(c_custkey as varchar) id, c_mktsegment status from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc nulls last, cast(c_custkey as varchar)) r from customer) where r <= 3")
def templates_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three templates of each status that were used last (a top-k report)."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("last_used_at"))
    out = None
    for status in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        own = templates_top(t, status)
        out = own if out is None else out.unionByName(own)
    return out.select("id", "status")


def templates_top(rows: DataFrame, status: str, k: int = 3) -> DataFrame:
    return jobs.templates_by_use(rows, status).limit(k)


@query("""
    with t as (select o_orderkey i, o_custkey % 50 d, o_orderstatus s, o_totalprice p from orders)
    select cast(d as varchar) "domain", s goal_signature, max_by(cast(i as varchar), i) id from t group by 1, 2""")
def templates_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template for each domain, signature and pattern: the newest."""
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), (F.col("o_custkey") % 50).cast("string").alias("domain"), F.col("o_orderstatus").alias("goal_signature"), F.lit("/*").alias("url_pattern"), k.alias("updated_at"))
    return templates.upsert_templates(t.where(k % 2 == 0), t.where(k % 2 == 1)).select("domain", "goal_signature", "id")


@query("""select "column", cast(row_number() over (order by first) - 1 as int) place from (select 'id' as "column", min(o_orderkey * 10) first from orders union all select 'odd ' || o_orderstatus, min(o_orderkey * 10 + 1) from orders where o_orderkey % 2 = 1 group by 1 union all select 'p', min(o_orderkey * 10 + 2) from orders)""")
def csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the records' keys, in the order in which they come up first."""
    k = F.col("o_orderkey")
    pairs = F.array(F.struct(F.lit("id").alias("k"), k.cast("string").alias("v")), F.when(k % 2 == 1, F.struct(said("odd ", F.col("o_orderstatus")).alias("k"), F.lit("1").alias("v"))), F.struct(F.lit("p").alias("k"), F.lit("x").alias("v")))
    rows = table(spark, sf_dir, "orders").select(k.alias("page_id"), F.lit(0).alias("row_idx"), F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).alias("record"))
    return spark.createDataFrame(list(enumerate(export.header_of(rows))), "place int, column string")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("tags"), F.create_map(F.lit("b"), k % 7, F.lit("a"), k % 5).alias("m"), F.when(k % 3 == 0, said('say "', k, '",\nthen')).alias("note"))


@query("""select cast(o_orderkey as varchar) id, o_orderstatus || '; ' || o_orderpriority tags, 'a=' || o_orderkey % 5 || '; b=' || o_orderkey % 7 m, case when o_orderkey % 3 = 0 then 'say "' || o_orderkey || '",' || chr(10) || 'then' else '' end note from orders""")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files as they are read back: lists and maps as text, nulls empty, quotes and line ends within cells."""
    path = _folder(spark, "csv")
    export.write_csv(_cells(spark, sf_dir), path)
    read = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return read.select("id", "tags", "m", F.coalesce("note", F.lit("")).alias("note"))


@query("""select o_orderkey id, o_orderstatus || '/' || o_orderpriority tags, o_orderkey % 5 a, case when o_orderkey % 3 = 0 then 'say "' || o_orderkey || '",' || chr(10) || 'then' end note from orders""")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    export.write_json(_cells(spark, sf_dir), path)
    read = spark.read.schema("id long, tags array<string>, m map<string,long>, note string").json(path)
    return read.select("id", F.array_join("tags", "/").alias("tags"), F.element_at("m", F.lit("a")).alias("a"), "note")


@query("select 'j' || o_orderkey job_id, case when o_orderkey % 2 = 0 then 'plan' else 'error' end kind, '{\"k\":' || o_orderkey || '}' body from orders")
def artifact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = _folder(spark, "artifacts"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("job_id", said("j", k))
    body = F.struct(k.alias("k"))
    artifacts.write_artifacts(path, artifacts.artifact(rows.where(k % 2 == 0), "plan", body), artifacts.artifact(rows.where(k % 2 == 1), "error", body))
    return artifacts.read_artifacts(spark, path).select("job_id", "kind", F.col("body").cast("string").alias("body"))


@query("select event_type as key, count(*) n, cast(count(*) as double) total from events where value is not null group by 1")
def metrics_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of counters and histograms, as it is read back."""
    e = table(spark, sf_dir, "events").where("value is not null")
    path = _folder(spark, "metrics")
    none = F.create_map().cast("map<string,string>")
    artifacts.dump_metrics(metrics.counters(e.select(F.col("event_type").alias("name"), none.alias("labels"), F.lit(1.0).alias("value"))), metrics.histograms(e.select(F.col("event_type").alias("key"), "value"), ["key"]), path)
    read = spark.read.json(path)
    return read.groupBy("key").agg(F.max("count").alias("n"), F.max("total").alias("total"))


# --- Streams ---------------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, a file or a folder of files, as a stream of files."""
    # as a pattern the path may be either; a stream takes a plain path for a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given when all of its input is read: of an update the latest row, so batches are kept with their number."""
    spark = stream.sparkSession
    path, state = _folder(spark, "stream"), _folder(spark, "stream-state")
    spark.createDataFrame([], stream.schema.add("batch", "long")).write.parquet(path)
    keep = lambda df, number: df.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("select event_type as name, date_trunc('day', ts) as day, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of metric events by day, from a stream."""
    e = _streamed(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("at"))
    out = _drained(streaming.metric_windows(e, "1 day", "1 hour"), "update")
    last = out.groupBy("name", "window").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("name", F.col("window.start").cast("timestamp_ntz").alias("day"), "x.n", F.round("x.total", 4).alias("total"))


@query("select distinct user_id from events")
def stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a stream, without those whose key came before."""
    e = _streamed(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("idempotency_key"), "user_id", F.col("ts").cast("timestamp").alias("requested_at"))
    return _drained(streaming.first_requests(e, "3650 days"), "append").select("user_id")


@query(f"""
    select page_id, cast(length(html) as int) markup_length, substr({_duck_text("regexp_extract(html, '<title>(.*?)</title>', 1)")}, 1, 300) title, cast(length({_DUCK_VISIBLE}) as int) visible_length,
           case when length({_DUCK_VISIBLE}) > 3000 then 'article' else 'generic_content' end page_type
    from pages""")
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a stream, parsed and analysed batch by batch."""
    path = _folder(spark, "analysed")
    keep = lambda df, _: df.select("page_id", "markup_length", "compact").write.mode("append").parquet(path)
    stream = _streamed(spark, sf_dir, "pages")
    keep(streaming.analyzed(spark.createDataFrame([], stream.schema)), -1)  # a stream without files has no batches
    streaming.analyzed_batches(stream, keep, _folder(spark, "analysed-state"), whole_references=True).awaitTermination()
    return spark.read.parquet(path).select("page_id", "markup_length", "compact.title", F.col("compact.visible_text_length").alias("visible_length"), F.col("compact.page_type_hint").alias("page_type"))


# --- Engine ----------------------------------------------------------------------------------------------------------------

#: The queries' SQL has all records of whole pages.
WHOLE = Settings.of(max_records=0, max_html_bytes=0)


@query("select cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) page_id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) title, '$' || cast(cast(p_retailprice as decimal(12,2)) as varchar) price, 'https://shop.example.com/part/' || p_partkey url from part")
def engine_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instruction over pages of one layout (a page for each brand), from intent and plan to records."""
    engine = api.Engine(spark, settings=WHOLE)
    part = table(spark, sf_dir, "part").withColumn("p_size", F.lit(0))
    pages = part_pages(spark, part).withColumn("page_id", F.floor(F.col("page_id") / 100))
    result = engine.extract(pages, "Extract the title, price and url of all products", options=Options(max_records=None), semantic=False)
    return result.table().select("page_id", "title", "price", "url")


@query("select 'cold' run, count(*) n, cast(count(*) as bigint) answered, cast(0 as bigint) planned_by_template from (select distinct p_brand from part where p_size = 1) union all select 'warm', count(*), cast(0 as bigint), count(*) from (select distinct p_brand from part where p_size = 2)")
def engine_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are made again are answered from the store; other pages of their layout are served by its template."""
    store = Store(spark, _folder(spark, "engine"))
    store.migrate()
    engine = api.Engine(spark, store=store, settings=WHOLE)
    pages = staged(part_pages(spark, sf_dir))
    ask, options = "Extract the title, price and url of all products", Options(max_records=None)
    plan = Plan("repeated_dom_selector", container="article", fields=(FieldSelector("title", "h2"), FieldSelector("price", ".price"), FieldSelector("url", "a.link", "href")))
    engine.extract(pages.where("page_id % 100 = 1"), ask, options=options, semantic=False, plan=plan)
    again = engine.extract(pages.where("page_id % 100 = 1 or page_id % 100 = 2"), ask, options=options, semantic=False)
    rows = again.jobs.withColumn("run", F.when(F.col("page_id") % 100 == 1, "cold").otherwise("warm"))
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("message") == "cached_idempotent_response").alias("answered"), F.count_if(F.col("diagnostics.template_used") & ~F.coalesce(F.col("message") == "cached_idempotent_response", F.lit(False))).alias("planned_by_template"))


@query("select c_custkey page_id, substr(sha256('https://shop.example.com/' || c_custkey || chr(10) || 'get ' || c_mktsegment), 1, 32) idempotency_key from customer")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("page_id"), txt.idempotency_key(said("https://shop.example.com/", F.col("c_custkey")), said("get ", F.col("c_mktsegment"))).alias("idempotency_key"))
