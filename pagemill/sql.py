"""Table functions for SQL: html_nodes(html), html_links(html, base), html_tables(html). `register` puts them into a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagemill.operators.dom import AT_ATTRS, AT_DEPTH, AT_LAST, AT_NID, AT_PID, AT_TAG, AT_TEXT, parse


def _text(nodes: list[list], nid: int) -> str:
    return " ".join("".join(n[AT_TEXT] for n in nodes[nid : nodes[nid][AT_LAST] + 1] if n[AT_TAG] == "#text").split())


class HtmlNodes:
    """A row for each element."""

    def eval(self, html: str) -> Iterator[tuple]:
        nodes = parse(html)
        for n in nodes:
            if n[AT_ATTRS] is not None:
                yield n[AT_NID], n[AT_PID], n[AT_DEPTH], n[AT_TAG], n[AT_ATTRS], _text(nodes, n[AT_NID])


class HtmlLinks:
    """A row for each link that leads somewhere, resolved against a base."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        from urllib.parse import urljoin

        nodes = parse(html)
        for n in nodes:
            href = ((n[AT_ATTRS] or {}).get("href") or "").strip()
            if n[AT_TAG] == "a" and href and not href.startswith("#") and not href.lower().startswith("javascript:"):
                yield _text(nodes, n[0]), urljoin(base or "", href)


class HtmlTables:
    """A row for each row of each table: table and row numbers from 0, and its cells."""

    def eval(self, html: str) -> Iterator[tuple]:
        nodes = parse(html)
        for t, table in enumerate(n for n in nodes if n[AT_TAG] == "table"):
            for r, tr in enumerate(n for n in nodes[table[AT_NID] : table[AT_LAST] + 1] if n[AT_TAG] == "tr"):
                yield t, r, [_text(nodes, c[AT_NID]) for c in nodes[tr[AT_NID] : tr[AT_LAST] + 1] if c[AT_TAG] in ("td", "th")]


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_nodes", udtf(HtmlNodes, returnType="nid int, pid int, depth int, tag string, attrs map<string,string>, text string"))
    spark.udtf.register("html_links", udtf(HtmlLinks, returnType="text string, href string"))
    spark.udtf.register("html_tables", udtf(HtmlTables, returnType="table_no int, row_no int, cells array<string>"))
