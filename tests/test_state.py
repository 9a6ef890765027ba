"""Keyed state with timers and time to live, over several batches and restarts."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone

import pytest

from pagemill.streaming import state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def bucket_rule(arrivals, rate, burst, wait):
    """The rule as a clock would see it: one after another, asleep until a token is there, given up if that were too late."""
    out, tokens, counted, lock = {}, {}, {}, {}
    for d, at, seq in sorted(arrivals, key=lambda x: (x[0], x[1], x[2])):
        now = max(at, lock.get(d, at))
        tokens[d] = min(burst, tokens.get(d, burst) + (now - counted.get(d, now)) * rate)
        counted[d] = now
        if tokens[d] < 1:
            pause = (1 - tokens[d]) / rate
            if now + pause > at + wait:
                out[d, seq], lock[d] = None, now
                continue
            now += pause
            tokens[d], counted[d] = 1.0, now
        tokens[d] -= 1
        lock[d] = out[d, seq] = now
    return out


def drained(stream, path, checkpoint, **trigger):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger or {"availableNow": True}).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def test_rates_by_event_time_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(6)
    arrivals, seq = [], 0
    for d in ("a", "b", "c"):
        t = 0.0
        for _ in range(40):
            t += rng.choice([0.0, 0.1, 0.3, 2.0])
            arrivals.append((d, round(t, 1), seq))
            seq += 1
    # batches by arrival, with rows up to a second late; the last row drives the watermark past all others
    batches = [[], [], [], [("end", 10_000.0, 9_999)]]
    for a in arrivals:
        batches[min(2, int((a[1] + rng.random()) // 12))].append(a)
    schema = "domain string, at timestamp, seq long"
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for rows in batches:
        rng.shuffle(rows)
        spark.createDataFrame([(d, START + timedelta(seconds=t), s) for d, t, s in rows], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        drained(state.rate_limited(stream, rate=1.0, burst=2, wait=2.5, delay="2 seconds"), out, check)  # a restart each
    got = {(r.domain, r.seq): (r.start, r.given_up) for r in spark.read.parquet(out).where("domain <> 'end'").collect()}
    want = bucket_rule(arrivals, 1.0, 2.0, 2.5)
    assert got.keys() == want.keys()
    for k, start in want.items():
        assert got[k][1] == (start is None)
        assert start is None or got[k][0] - START.timestamp() == pytest.approx(start, abs=1e-5)
    assert 0 < sum(s is None for s in want.values()) < len(want)
    # idle domains have no state any more
    assert {k[0] for k in state.idle_states(spark, check, "bucket")} <= {"end"}


def test_a_give_up_takes_no_token():
    bucket, starts = (1.0, 0.0, 0.0), []
    for at in (0.0, 0.0, 0.0, 1.6):
        bucket, start = state.admitted(bucket, at, rate=0.5, burst=1.0, wait=1.5)
        starts.append(start)
    assert starts == [0.0, None, None, 2.0]  # the token of 2.0 was left for the last


def test_hosts_are_asked_once_in_their_time(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def fetch(url):
        with open(asked, "a") as f:
            f.write(url + "\n")
        if "down" in url:
            raise OSError("down")
        return "User-agent: *\nDisallow: /private" if "//a/" in url else None

    schema = "page_id long, host string, canonical string"
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def batch(rows, ttl):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        drained(state.robots_judged(spark.readStream.schema(schema).parquet(src), fetch, "pagemill", ttl=ttl), out, check, once=True)

    for k in range(3):
        batch([(10 * k, "a", "https://a/x"), (10 * k + 1, "a", "https://a/private/y"), (10 * k + 2, "down", "https://down/"), (10 * k + 3, "b", "https://b/"), (10 * k + 4, None, "x")], 3600)
    rows = spark.read.parquet(out).collect()
    assert {(r.page_id % 10, r.robots) for r in rows} == {(0, "allowed"), (1, "disallowed"), (2, "no_robots"), (3, "no_robots")} and len(rows) == 12
    assert sorted(open(asked).read().split()) == ["https://a/robots.txt", "https://b/robots.txt", "https://down/robots.txt"]
    assert all(r.fetched == (r.page_id < 10) for r in rows)


def test_rules_go_with_their_time(spark, tmp_path):
    schema = "page_id long, host string, canonical string"
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(2):
        spark.createDataFrame([(k, "a", "https://a/")], schema).write.mode("append").parquet(src)
        drained(state.robots_judged(spark.readStream.schema(schema).parquet(src), lambda u: "", "pagemill", ttl=0.5), out, check, once=True)
        time.sleep(1)
    assert {(r.page_id, r.robots, r.fetched) for r in spark.read.parquet(out).collect()} == {(0, "allowed", True), (1, "allowed", True)}
