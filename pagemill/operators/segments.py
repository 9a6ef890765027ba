"""Running values over the ordered rows of a key, however many rows one key has.

Rows are range-partitioned by key and order, so that a key's rows are a chain of segments, one a task; windows are those of a
segment. What a segment hands on is one row, and only the first key of a task gets anything from the one before: so what
is broadcast has at most a row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .staging import staged

SEGMENT = "_segment"


def segmented(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """`rows` with the number of their segment; a key's segments follow each other as its rows do."""
    return staged(rows.repartitionByRange(key, *order).withColumn(SEGMENT, F.spark_partition_id()))


def within(key: str, order: tuple[str, ...]) -> WindowSpec:
    """The rows of a key in a segment, in order."""
    return Window.partitionBy(SEGMENT, key).orderBy(*order)


def along(key: str) -> WindowSpec:
    """The segments of a key, in order; a row each."""
    return Window.partitionBy(key).orderBy(SEGMENT)


def carried(rows: DataFrame, key: str, carries: DataFrame) -> DataFrame:
    """`rows` with what their segment is handed; `carries` has a row for each segment that continues a key, at most one a task."""
    return rows.join(F.broadcast(carries), [SEGMENT, key], "left")
