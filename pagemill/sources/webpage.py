"""Pages by URL as a Python data source (`format("webpage")`): fetching is injected, so tests and offline runs need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "page_id long, url string, final_url string, status int, content_type string, html string, error string"
#: Bytes of a page at most; the rest is cut off.
MOST_BYTES = 5 << 20
KINDS = ("text/html", "application/xhtml+xml", "application/xml", "text/xml")


def decoded(raw: bytes, charset: str | None) -> str:
    """A page's text: at most MOST_BYTES, in its charset or UTF-8; bytes that are none are replaced."""
    raw = raw[:MOST_BYTES]
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def fetch_http(url: str, seconds: float = 8.0) -> tuple[str, int, str, bytes, str | None]:
    """(final URL, status, content type, body, charset) of a GET."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "pagemill"}), timeout=seconds) as r:  # noqa: S310
        return r.geturl(), r.status, r.headers.get_content_type(), r.read(MOST_BYTES), r.headers.get_content_charset()


def page_row(page_id: int, url: str, fetch: Callable[[str], tuple]) -> tuple:
    """A row of PAGES; what goes wrong is its error, never the job's."""
    try:
        final, status, kind, raw, charset = fetch(url)
    except Exception as e:  # noqa: BLE001
        return page_id, url, None, None, None, None, f"fetch_error: {e}"[:500]
    if status >= 400:
        return page_id, url, final, status, kind, None, f"fetch_error: status {status}"
    if kind and not kind.lower().startswith(KINDS):
        return page_id, url, final, status, kind, None, "unsupported_content_type"
    return page_id, url, final, status, kind, decoded(raw, charset), None


def fetched(urls: DataFrame, fetch: Callable[[str], tuple] = fetch_http, *, partitions: int | None = None) -> DataFrame:
    """The pages of (page_id, url, host). One task owns a host, so that a rate limit is kept within it."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGES.split(", ")]
        for pdf in batches:
            rows = [page_row(i, u, fetch) for i, u in zip(pdf["page_id"], pdf["url"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out["status"] = out["status"].astype("Int32")
            yield out

    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return urls.select("page_id", "url", "host").repartition(n, "host").select("page_id", "url").mapInPandas(run, PAGES)


class _Range(InputPartition):
    def __init__(self, first: int, urls: list[str]) -> None:
        self.first, self.urls = first, urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], per_task: int) -> None:
        self.urls, self.per_task = urls, per_task

    def partitions(self) -> list[InputPartition]:
        return [_Range(i, self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [_Range(0, [])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for i, url in enumerate(partition.urls):
            yield page_row(partition.first + i, url, fetch_http)


class WebPages(DataSource):
    """spark.read.format("webpage").option("urls", "one URL a line").load(): for lists of URLs; tables of URLs go through `fetched`."""

    @classmethod
    def name(cls) -> str:
        return "webpage"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader([u for u in self.options.get("urls", "").splitlines() if u], int(self.options.get("urls_per_task", "16")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)


def sufficient(pages: DataFrame) -> DataFrame:
    """The pages that were fetched."""
    return pages.where(F.col("error").isNull())
