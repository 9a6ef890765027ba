"""Rendered pages: an injected renderer, or a table of pages that were rendered before, for pages whose static HTML is not enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a renderer worker does: opened once a task, called for each URL, closed at the end or after `recycle` pages.
Opener = Callable[[], "Renderer"]
RENDERED = "page_id long, rendered_html string, render_error string"


class Renderer:
    """render(url) -> HTML; close() frees what it holds. A subclass may drive a browser."""

    def render(self, url: str) -> str:
        raise NotImplementedError

    def close(self) -> None:
        """Nothing to free."""


def rendered(pages: DataFrame, opener: Opener, *, workers: int = 3, recycle: int = 50) -> DataFrame:
    """(page_id, rendered_html, render_error) of `pages` (page_id, url). `workers` renderers run at a time; each is opened anew after `recycle` pages. What goes wrong is a row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, used = None, 0
        try:
            for pdf in batches:
                rows = []
                for page_id, url in zip(pdf["page_id"], pdf["url"], strict=True):
                    try:
                        if own is None or used >= recycle:
                            if own is not None:
                                own.close()
                            own, used = opener(), 0
                        used += 1
                        rows.append((page_id, own.render(url), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((page_id, None, f"render_error: {e}"[:500]))
                yield pd.DataFrame(rows, columns=["page_id", "rendered_html", "render_error"])
        finally:
            if own is not None:
                own.close()

    return pages.select("page_id", "url").repartition(workers, "page_id").mapInPandas(run, RENDERED)


def pre_rendered(pages: DataFrame, table: DataFrame) -> DataFrame:
    """The same from a table (url, html) of pages that were rendered before; URLs that it lacks have an error."""
    own = table.groupBy("url").agg(F.min("html").alias("rendered_html"))
    return pages.select("page_id", "url").join(own, "url", "left").select("page_id", "rendered_html", F.when(F.col("rendered_html").isNull(), "render_error: not among the rendered pages").alias("render_error"))


def with_rendered(pages: DataFrame, found: DataFrame, wanted: Column) -> DataFrame:
    """`pages` (page_id, html) with the rendered HTML where `wanted` holds and rendering went well; mode: static or browser."""
    rows = pages.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).join(found, "page_id", "left")
    use = F.col("_wanted") & F.col("rendered_html").isNotNull()
    rows = rows.withColumn("html", F.when(use, F.col("rendered_html")).otherwise(F.col("html"))).withColumn("mode", F.when(use, "browser").otherwise("static"))
    return rows.drop("rendered_html", "_wanted")
