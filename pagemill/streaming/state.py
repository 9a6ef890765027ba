"""Keyed state with timers and time to live: request rates by domain, and robots rules by host.

Both need a RocksDB state store (`use_rocksdb`). State is what a key's bucket or rules are, and the arrivals that wait for the watermark; it
survives restarts with the query's checkpoint and goes when it says nothing any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RATED = "domain string, seq long, at double, start double, given_up boolean"
VERDICTS = "page_id long, host string, canonical string, robots string, fetched boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers is kept by RocksDB alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


Bucket = tuple[float, float, float]  # tokens, when they were counted, when the one before was through


def admitted(bucket: Bucket, at: float, *, rate: float, burst: float, wait: float) -> tuple[Bucket, float | None]:
    """The bucket after one more arrival, and when it may start; None if it gives up, which takes no token.

    Arrivals of a key are served one after another. One whose turn comes sleeps until a token is there, unless that were later than `wait` after it came.
    """
    tokens, counted, free = bucket
    turn = max(at, free)
    tokens = min(burst, tokens + (turn - counted) * rate)
    if tokens >= 1.0:
        return (tokens - 1.0, turn, turn), turn
    start = turn + (1.0 - tokens) / rate
    if start > at + wait:
        return (tokens, turn, turn), None
    return (0.0, start, start), start


class RateLimiter(StatefulProcessor):
    """A token bucket for each domain. Arrivals wait in state until the watermark has passed them, so that their order is final; a timer then serves them."""

    def __init__(self, rate: float, burst: float, wait: float) -> None:
        self.rate, self.burst, self.wait = rate, burst, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, counted double, free double")
        self.waiting = handle.getListState("waiting", "at double, seq long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        first = None
        for pdf in rows:
            at = pdf["at"].astype("int64").to_numpy() / 1e6 if pdf["at"].dtype.kind == "M" and pdf["at"].dtype == "datetime64[us]" else pdf["at"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            own = list(zip(at.tolist(), pdf["seq"].tolist(), strict=True))
            self.waiting.appendList(own)
            least = min(t for t, _ in own)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(int(first * 1000) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        now = timerValues.getCurrentWatermarkInMs() / 1000
        every = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in every if x[0] < now]
        bucket = self.bucket.get() if self.bucket.exists() else None
        out = []
        for at, seq in due:
            bucket = (self.burst, at, at) if bucket is None else bucket
            bucket, start = admitted(bucket, at, rate=self.rate, burst=self.burst, wait=self.wait)
            out.append((key[0], seq, at, start, start is None))
        rest = every[len(due) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(int(rest[0][0] * 1000) + 1)
        elif due:
            self.waiting.clear()
        if bucket is not None:
            full = bucket[1] + (self.burst - bucket[0]) / self.rate
            if not rest and now >= max(full, bucket[2]):
                self.bucket.clear()  # a full bucket is as good as none
            else:
                self.bucket.update(tuple(map(float, bucket)))
                if not rest:
                    self.handle.registerTimer(int(max(full, bucket[2]) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["domain", "seq", "at", "start", "given_up"])

    def close(self) -> None:
        pass


def rate_limited(arrivals: DataFrame, *, rate: float = 1.0, burst: int = 1, wait: float = 5.0, delay: str = "0 seconds") -> DataFrame:
    """A stream of arrivals (domain, at: a timestamp, seq) to their starts: domain, seq, at and start (seconds since 1970), given_up.

    Arrivals that come later than `delay` after younger ones are not served. Rows leave when the watermark has passed them. A domain that is idle
    until its bucket is full has no state.
    """
    own = arrivals.select("domain", "at", F.col("seq").cast("long").alias("seq")).withWatermark("at", delay)
    return own.groupBy("domain").transformWithStateInPandas(statefulProcessor=RateLimiter(float(rate), float(burst), float(wait)), outputStructType=RATED, outputMode="append", timeMode="eventTime")


class RobotsRules(StatefulProcessor):
    """The rules of a host, fetched once in a time to live; what could not be fetched counts as no rules for as long."""

    def __init__(self, fetch: Callable[[str], str | None], agent: str, ttl: float, scheme: str) -> None:
        self.fetch, self.agent, self.ttl, self.scheme = fetch, agent, ttl, scheme

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rules = handle.getValueState("rules", "text string", ttlDurationMs=int(self.ttl * 1000))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        from urllib.robotparser import RobotFileParser

        asked = not self.rules.exists()
        if asked:
            try:
                text = self.fetch(f"{self.scheme}://{key[0]}/robots.txt")
            except Exception:  # noqa: BLE001
                text = None
            self.rules.update((text,))
        else:
            text = self.rules.get()[0]
        parser = RobotFileParser()
        parser.parse((text or "").splitlines())
        for pdf in rows:
            said = ["no_robots" if text is None else "allowed" if parser.can_fetch(self.agent, u or "") else "disallowed" for u in pdf["canonical"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "host": key[0], "canonical": pdf["canonical"], "robots": said, "fetched": asked})

    def close(self) -> None:
        pass


def robots_judged(pages: DataFrame, fetch: Callable[[str], str | None], agent: str, *, ttl: float = 3600.0, scheme: str = "https") -> DataFrame:
    """A stream of pages (page_id, host, canonical) with robots: allowed, disallowed or no_robots; fetched: whether this batch asked the host. A host is asked once in `ttl` seconds.

    Time to live is by the clock, so there is always another batch to run: such a query ends by stop() or after one batch, not by itself.
    """
    own = pages.select("page_id", "host", "canonical").where("host is not null")
    return own.groupBy("host").transformWithStateInPandas(statefulProcessor=RobotsRules(fetch, agent, ttl, scheme), outputStructType=VERDICTS, outputMode="append", timeMode="processingTime")


def idle_states(spark: SparkSession, checkpoint: str, name: str) -> Iterator[tuple]:
    """The keys that have a state of a name in a query's checkpoint, for looking into it."""
    for r in spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().select("key").toLocalIterator():
        yield tuple(r.key)
