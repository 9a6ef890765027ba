"""The compacted store: equal results before and after compaction, look-ups that open their buckets alone, one state for a reader."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import jobs
from pagemill.sources import store

COLUMNS = [c.split() for c in store.JOBS.split(", ")]


def job_rows(spark, rows):
    """Jobs of (id, key, status, minute)."""
    own = spark.createDataFrame(rows, "id string, idempotency_key string, status string, minute int")
    at = F.timestamp_seconds(F.col("minute") * 60).cast("timestamp_ntz")
    own = own.withColumns({"created_at": at, "updated_at": at})
    return own.select(*((F.col(n) if n in own.columns else F.lit(None)).cast(t).alias(n) for n, t in COLUMNS))


def state(df):
    return {r.id: (r.idempotency_key, r.status) for r in df.collect()}


@pytest.fixture
def filled(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), bucket_rows=40)
    s.migrate()
    rng, want = random.Random(3), {}
    for minute in range(4):
        rows = [(f"j{i}", f"k{i % 150}", rng.choice(["running", "success", "failed"]), minute) for i in rng.sample(range(400), 150)]
        s.append("jobs", job_rows(spark, rows))
        want |= {r[0]: (r[1], r[2]) for r in rows}
    return s, want


def test_compaction_leaves_results_equal(spark, filled):
    s, want = filled
    assert state(s.table("jobs")) == want
    m = s.compact("jobs")
    assert m.deltas == [] and m.buckets == 16 and state(s.table("jobs")) == want
    s.append("jobs", job_rows(spark, [("j1", "k1", "late", 0), ("j2", "k2", "last", 99), ("new", "k1", "success", 5)]))
    want |= {"j2": ("k2", "last"), "new": ("k1", "success")}
    if "j1" not in want:
        want["j1"] = ("k1", "late")  # an older version than the one that is there does not count
    assert state(s.table("jobs")) == want
    before = s.manifest("jobs").snapshot
    after = s.compact("jobs").snapshot
    assert state(s.table("jobs")) == want
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2  # the buckets of k1 and k2
    assert s.compact("jobs").snapshot == after and s.versions("jobs").count() == len(want)


def test_lookups_open_the_buckets_of_their_keys(spark, filled):
    s, want = filled
    s.compact("jobs")
    keys = spark.createDataFrame([("k7",), ("k7",), (None,), ("nobody",)], "k string")
    found = s.lookup("jobs", "idempotency_key", keys)
    assert state(found) == {i: v for i, v in want.items() if v[0] == "k7"}
    assert 1 <= len(found.inputFiles()) <= 2 < 16 <= len(s.table("jobs").inputFiles())
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(idempotency_key" in plan.replace("IsNotNull", "")
    many = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"))
    assert state(s.lookup("jobs", "idempotency_key", many)) == want
    assert state(s.one("jobs", next(iter(want)))) == dict([next(iter(want.items()))])
    assert state(s.by_id("jobs", many.select(F.lit("none").alias("id")))) == {}
    # with rows that were appended since
    s.append("jobs", job_rows(spark, [("j7", "k7", "anew", 50)]))
    assert state(s.lookup("jobs", "idempotency_key", keys))["j7"] == ("k7", "anew")


def test_files_have_bloom_filters(spark, filled):
    s, _ = filled
    s.compact("jobs")
    name = s.table("jobs").inputFiles()[0]
    footer = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(name), spark._jsc.hadoopConfiguration()))
    try:
        columns = footer.getFooter().getBlocks().get(0).getColumns()
        with_bloom = {c.getPath().toDotString() for c in columns if c.getBloomFilterOffset() >= 0 or c.getEncodings().toString().find("DICTIONARY") >= 0}
    finally:
        footer.close()
    assert {"id", "idempotency_key"} <= with_bloom


def test_a_reader_has_one_state(spark, filled):
    s, want = filled
    reading = s.table("jobs")  # not worked out yet
    s.append("jobs", job_rows(spark, [("other", "k1", "success", 9)]))
    s.compact("jobs")
    s.append("jobs", job_rows(spark, [("another", "k1", "success", 9)]))
    assert state(reading) == want
    assert set(state(s.table("jobs"))) == {*want, "other", "another"}
    assert s.vacuum("jobs", keep=1) >= 4 and set(state(s.table("jobs"))) == {*want, "other", "another"}


def test_writers_do_not_lose_each_others_rows(spark, filled):
    s, want = filled
    other = store.Store(spark, s.path)
    seen = []

    def late(m):  # another writer's rows come between reading the manifest and putting the next
        if not seen:
            seen.append(1)
            other.append("jobs", job_rows(spark, [("theirs", "k", "success", 1)]))
        return store.Manifest(0, m.buckets, m.snapshot, [*m.deltas])

    s._swap("jobs", late)
    assert "theirs" in state(s.table("jobs"))
    old = s.compact("jobs")
    with pytest.raises(store.Conflict):
        s._swap("jobs", lambda m: (_ for _ in ()).throw(store.Conflict("x")))
    assert s.manifest("jobs") == old


def test_many_appends_are_compacted(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), most_deltas=3)
    for i in range(7):
        s.append("jobs", job_rows(spark, [(f"j{i % 5}", "k", "success", i)]))
    assert len(s.manifest("jobs").deltas) < 3 and s.table("jobs").count() == 5
    assert s.table("results").count() == 0 and s.lookup("results", "job_id", spark.createDataFrame([("x",)], "j string")).count() == 0
    s.compact("templates")
    assert s.manifest("templates").version == 0


def test_finished_jobs_are_looked_up_by_key(spark, filled):
    s, want = filled
    s.compact("jobs")
    asked = spark.createDataFrame([("k3",), ("k77",), ("none",)], "idempotency_key string")
    by_table = {r.idempotency_key: r.cached_job_id for r in jobs.finished(asked, s.table("jobs")).collect()}
    by_lookup = {r.idempotency_key: r.cached_job_id for r in jobs.finished(asked, s.lookup("jobs", "idempotency_key", asked)).collect()}
    assert by_table == by_lookup and by_table["none"] is None
