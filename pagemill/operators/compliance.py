"""What may be fetched: addresses and robots.txt. Both look at one row at a time; name resolution and fetching are injected."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def address_is_public(ip: str | None) -> bool:
    import ipaddress

    try:
        a = ipaddress.ip_address(ip or "")
    except ValueError:
        return False
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified)


@F.pandas_udf(T.BooleanType())
def _all_public(addresses: pd.Series) -> pd.Series:
    return pd.Series([a is not None and len(a) > 0 and all(map(address_is_public, a)) for a in addresses])


def host_allowed(addresses: Column, allow_private: bool = False) -> Column:
    """Whether a host with these resolved addresses may be fetched; an unresolved one may not."""
    return F.lit(True) if allow_private else _all_public(addresses)


def resolved(hosts: DataFrame, resolve: Callable[[str], list[str]], *, host: str = "host") -> DataFrame:
    """Distinct hosts with their addresses, by an injected resolver; one that fails has none."""
    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for h in pdf[host]:
                try:
                    out.append(list(resolve(h)))
                except OSError:
                    out.append([])
            yield pd.DataFrame({host: pdf[host], "addresses": out})

    return hosts.select(host).distinct().mapInPandas(run, f"{host} string, addresses array<string>")


def robots_verdict(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """`pages` (host, canonical) with robots: allowed, disallowed, or no_robots where a host has no rules.

    `robots` has a row (host, rules) for each host; it is joined by host, and Spark broadcasts it if it is small.
    """
    @F.pandas_udf(T.StringType())
    def verdict(rules: pd.Series, urls: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        parsed: dict[str, RobotFileParser] = {}
        out = []
        for text, url in zip(rules, urls, strict=True):
            if text is None:
                out.append("no_robots")
                continue
            if text not in parsed:
                if len(parsed) > 1000:
                    parsed.clear()
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            out.append("allowed" if parsed[text].can_fetch(agent, url or "") else "disallowed")
        return pd.Series(out, dtype=object)

    return pages.join(robots.select("host", "rules"), "host", "left").withColumn("robots", verdict("rules", "canonical")).drop("rules")


def robots_source(hosts: DataFrame, fetch: Callable[[str], str | None], *, now: Column, known: DataFrame | None = None, ttl: int = 3600, scheme: str = "https") -> DataFrame:
    """(host, rules, fetched_at) of distinct hosts: those of `known` that are younger than ttl seconds, else fetched anew.

    `fetch(url)` is injected: it gives the text of a host's robots.txt, or None where there is none; what it raises counts as
    none, so that such hosts are open. A host is fetched once, by the task that owns it.
    """
    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            texts = []
            for h in pdf["host"]:
                try:
                    texts.append(fetch(f"{scheme}://{h}/robots.txt"))
                except Exception:  # noqa: BLE001
                    texts.append(None)
            yield pd.DataFrame({"host": pdf["host"], "rules": pd.Series(texts, dtype=object)})

    asked = hosts.select("host").where("host is not null").distinct()
    if known is None:
        return asked.mapInPandas(run, "host string, rules string").withColumn("fetched_at", now)
    fresh = known.where(F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(ttl))).groupBy("host").agg(F.max_by(F.struct("rules", "fetched_at"), "fetched_at").alias("x")).select("host", "x.rules", "x.fetched_at")
    fresh = fresh.join(asked, "host", "left_semi")
    return fresh.unionByName(asked.join(fresh, "host", "left_anti").mapInPandas(run, "host string, rules string").withColumn("fetched_at", now))


def is_html(content_type: Column) -> Column:
    """Whether a page may be parsed by its content type; an unknown one may."""
    kind = F.lower(F.trim(F.coalesce(content_type, F.lit(""))))
    out = kind == ""
    for prefix in ("text/html", "application/xhtml+xml", "application/xml", "text/xml"):
        out = out | kind.startswith(prefix)
    return out
