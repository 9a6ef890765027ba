"""Streams: template states, replay suppression, and continuous page analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions.embedded import embedded
from pagemill.operators.dom import parse_pages
from pagemill.operators.templates import ACTIVE_AFTER, BACK_AFTER, DROP_AFTER, LEAST_SCORE, REVIEW_AFTER

_STATE = "status string, successes int, failures int, score double"


def step(state: tuple[str, int, int, float], success: bool, score: float) -> tuple[str, int, int, float]:
    """A template's state after one more result; the same rules as operators.templates.advance."""
    status, wins, losses, rate = state
    if success:
        wins, losses, rate = wins + 1, 0, score
    else:
        wins, losses = 0, losses + 1
    if status != "deprecated":
        if losses >= DROP_AFTER:
            status = "deprecated"
        elif status == "candidate" and success and wins >= ACTIVE_AFTER and rate >= LEAST_SCORE or status == "needs_review" and success and wins >= BACK_AFTER:
            status = "active"
        elif status == "active" and losses >= REVIEW_AFTER:
            status = "needs_review"
    return status, wins, losses, rate


def lifecycle(results: DataFrame) -> DataFrame:
    """A stream of results (template_id long, ts, event_id, success, score) to the states of the templates that a batch touches (update mode).

    One small state a template. Results of a batch are applied in order of (ts, event_id).
    """
    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("candidate", 0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for success, score in zip(rows["success"], rows["score"], strict=True):
            now = step(now, bool(success), float(score))
        state.update(now)
        yield pd.DataFrame([[key[0], *now]], columns=["template_id", "status", "successes", "failures", "score"])

    return results.groupBy("template_id").applyInPandasWithState(update, f"template_id long, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)


def first_requests(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of requests (idempotency_key, requested_at) without those whose key was seen within the delay."""
    return requests.withWatermark("requested_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def metric_windows(events: DataFrame, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """A stream of metric events (name, value, at) to counts and sums by window; late events up to the delay count."""
    return events.withWatermark("at", delay).groupBy(F.window("at", window), "name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def analyzed(pages: DataFrame, whole_references: bool = False) -> DataFrame:
    """Pages (page_id, url, html), parsed (see `dom.parse`) and analysed."""
    from pagemill.operators.page import analyze

    return analyze(parse_pages(pages.withColumns({"markup_length": F.length("html"), "embedded": embedded(F.col("html"))}), whole_references=whole_references))


def analyzed_batches(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, whole_references: bool = False):  # noqa: ANN201
    """Starts a query that parses and analyses each batch of a stream of pages (page_id, url, html) and hands it to a sink."""
    return pages.writeStream.foreachBatch(lambda df, number: sink(analyzed(df, whole_references), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
