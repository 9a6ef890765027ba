"""URLs to pages: what may be fetched, in what order and how fast, as one chain of narrow steps around two small joins by host.

URLs are made canonical; hosts, each once, are resolved and asked for their robots.txt; what may not be fetched is a row with its error. The rest is dealt by
domain, and a task serves its domains' URLs in order under their token buckets and the job's deadline: a domain's rate is the bound on its work, so it is
one task's however many URLs it has, and a task interleaves its domains by who may start first.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_url
from pagemill.operators import compliance
from pagemill.operators.staging import staged
from pagemill.settings import Settings
from pagemill.streaming.state import Bucket, admitted

from .webpage import PAGES, page_row

Fetch = Callable[[str, float], tuple]
#: Seconds that an arrival waits for its token at most, and that one fetch may take.
MOST_WAIT, STEP_SECONDS = 5.0, 8.0


@dataclass(frozen=True)
class Clock:
    """Time as a task sees it."""

    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


def system_resolve(host: str) -> list[str]:
    import socket

    return sorted({x[4][0] for x in socket.getaddrinfo(host, None)})


def http_fetch(agent: str, most_bytes: int) -> Fetch:
    """A GET as (final URL, status, content type, body, charset), with the agent's name."""

    def fetch(url: str, seconds: float) -> tuple:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=seconds) as r:  # noqa: S310
            return r.geturl(), r.status, r.headers.get_content_type(), r.read(most_bytes + 1), r.headers.get_content_charset()

    return fetch


def checked(urls: DataFrame, settings: Settings, *, resolve: Callable[[str], list[str]], robots: Callable[[str], str | None], known_robots: DataFrame | None = None) -> DataFrame:
    """`urls` (page_id, url) with canonical, host, domain and error: invalid_url, dns, blocked_target or blocked_by_robots; null where a page may be fetched.

    Each host is resolved once and asked for its rules once; `known_robots` (host, rules, fetched_at) younger than the settings' time to live are not asked for.
    """
    u = F.col("_u")
    rows = urls.select("page_id", "url").withColumn("_u", normalize_url(F.col("url"))).select("page_id", "url", u["canonical"].alias("canonical"), u["host"].alias("host"), u["domain"].alias("domain"), u["error"].alias("_wrong"))
    rows = staged(rows)
    hosts = rows.where("_wrong is null").select("host").distinct()
    found = staged(compliance.resolved(hosts, resolve))
    open_host = compliance.host_allowed(F.col("addresses"), settings.allow_private_targets)
    judged = found.select("host", F.when(F.size("addresses") == 0, "dns").when(~open_host, "blocked_target").alias("_host_error"))
    judged = staged(judged)
    asked = judged.where("_host_error is null").select("host")
    rules = compliance.robots_source(asked, robots, now=F.current_timestamp(), known=known_robots, ttl=settings.robots_ttl_seconds)
    rows = compliance.robots_verdict(rows.join(judged, "host", "left"), staged(rules), settings.user_agent)
    error = F.when(F.col("_wrong").isNotNull(), "invalid_url").when(F.col("_host_error").isNotNull(), F.col("_host_error")).when(F.col("robots") == "disallowed", "blocked_by_robots")
    return rows.select("page_id", "url", "canonical", "host", "domain", "robots", error.alias("error"))


def served(rows: list[tuple], settings: Settings, fetch: Fetch, clock: Clock) -> Iterator[tuple]:
    """Rows of PAGES for a task's (domain, page_id, canonical), by domain and in order: domains take turns by who may start first.

    An arrival that would wait for a token longer than MOST_WAIT gives up; nothing starts when the job's deadline has passed, and no fetch takes longer
    than what is left of it.
    """
    begin = clock.now()
    end = begin + settings.job_deadline_seconds
    queues: dict[str, deque] = {}
    for domain, page_id, url in rows:
        queues.setdefault(domain, deque()).append((page_id, url))
    buckets: dict[str, Bucket] = {d: (float(settings.rate_burst), begin, begin) for d in queues}
    rate, burst = settings.rate_per_second, float(settings.rate_burst)
    heap = [(begin, d) for d in sorted(queues)]
    heapq.heapify(heap)
    while heap:
        _, domain = heapq.heappop(heap)
        page_id, url = queues[domain].popleft()
        now = clock.now()
        # It arrives when its domain is free for it: a task keeps a queue, so nobody waits for a token but the first in line.
        buckets[domain], start = admitted(buckets[domain], max(now, buckets[domain][2]), rate=rate, burst=burst, wait=MOST_WAIT)
        error = None if start is not None else "rate_limited"
        if start is not None and start >= end or clock.now() >= end:
            error = "deadline"
        if error is None:
            if start > (now := clock.now()):
                clock.sleep(start - now)
            left = min(STEP_SECONDS, end - clock.now())
            yield page_row(page_id, url, lambda u, s=left: fetch(u, s))
        else:
            yield page_id, url, None, None, None, None, error
        if queues[domain]:
            tokens, _, free = buckets[domain]
            heapq.heappush(heap, (free + max(0.0, 1.0 - tokens) / rate, domain))


def fetch_pages(urls: DataFrame, settings: Settings, *, fetch: Fetch | None = None, resolve: Callable[[str], list[str]] = system_resolve, robots: Callable[[str], str | None] | None = None, known_robots: DataFrame | None = None, clock: Clock | None = None, partitions: int | None = None) -> DataFrame:
    """A row of PAGES for each of `urls` (page_id, url): its page, or the error that says why there is none. Fetching, resolving and time are injected."""
    fetch = fetch or http_fetch(settings.user_agent, settings.max_html_bytes)
    clock = clock or Clock()
    robots = robots or (lambda url: _text(fetch, url))
    rows = staged(checked(urls, settings, resolve=resolve, robots=robots, known_robots=known_robots))
    names = [c.split()[0] for c in PAGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [r for pdf in batches for r in zip(pdf["domain"], pdf["page_id"], pdf["canonical"], strict=True)]
        out = []
        for row in served(own, settings, fetch, clock):
            out.append(row)
            if len(out) >= 16:
                yield _frame(out, names)
                out = []
        if out:
            yield _frame(out, names)

    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    allowed = rows.where("error is null").repartition(n, "domain").sortWithinPartitions("domain", "page_id").select("domain", "page_id", "canonical")
    none = F.lit(None)
    refused = rows.where("error is not null").select("page_id", F.coalesce("canonical", "url").alias("url"), *(none.cast(c.split()[1]).alias(c.split()[0]) for c in PAGES.split(", ")[2:-1]), "error")
    return allowed.mapInPandas(run, PAGES).unionByName(refused)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["status"] = out["status"].astype("Int32")
    return out


def _text(fetch: Fetch, url: str) -> str | None:
    _, status, _, body, charset = fetch(url, STEP_SECONDS)
    return body.decode(charset or "utf-8", "replace") if status < 400 else None
