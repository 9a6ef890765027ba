"""Records as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(value: Column, kind: T.DataType) -> Column:
    """A value as a CSV cell: null is empty, lists are joined by "; ", maps are k=v, sorted."""
    if isinstance(kind, T.ArrayType):
        value = F.array_join(F.transform(value, lambda x: x.cast("string")), "; ")
    elif isinstance(kind, T.MapType):
        value = F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), "; ")
    elif isinstance(kind, T.StructType):
        value = F.to_json(value)
    return F.coalesce(value.cast("string"), F.lit(""))


def cells(rows: DataFrame) -> DataFrame:
    """The same columns as text cells."""
    return rows.select(*(cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields))


def quoted(text: Column) -> Column:
    special = text.rlike("[\",\r\n]")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(rows: DataFrame) -> Column:
    """A row of cells as one CSV line, without its end."""
    return F.concat_ws(",", *(quoted(F.col(f"`{c}`")) for c in rows.columns))


def header_of(records: DataFrame, record: str = "record", order: tuple[str, ...] = ("page_id", "row_idx")) -> list[str]:
    """The union of the records' keys in first-seen order; a pre-aggregated minimum for each key, and one row a key to the driver."""
    keys = records.select(*order, F.posexplode(F.map_keys(record)).alias("at", "key"))
    return [r.key for r in keys.groupBy("key").agg(F.min(F.struct(*order, "at")).alias("first")).orderBy("first").collect()]


def flattened(records: DataFrame, columns: list[str] | None = None, record: str = "record") -> DataFrame:
    """Ragged records as a column a key (those given, or all); missing ones are empty."""
    columns = header_of(records, record) if columns is None else columns
    return records.select(*(F.coalesce(F.element_at(record, F.lit(c)), F.lit("")).alias(c) for c in columns))


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """CSV files, each with a header; quotes are doubled."""
    cells(rows).write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def csv_text(rows: DataFrame) -> DataFrame:
    """The same as lines with CRLF ends, for the text writer or one file: the header is the caller's."""
    text = cells(rows)
    return text.select(F.concat(csv_line(text), F.lit("\r\n")).alias("value"))


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A JSON object a line; nulls are kept."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def response_json(rows: DataFrame) -> DataFrame:
    """Responses (url, instruction, status, diagnostics, records) as indented JSON text."""
    return rows.select(F.to_json(F.struct("url", "instruction", "status", "diagnostics", "records"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
