"""Intents (the wanted fields) and plans (strategy and selectors), as plain values that travel as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import types as T

from pagemill.functions.normalize import TYPES

STRATEGIES = ["structured_data", "single_dom_selector", "repeated_dom_selector", "table_extraction", "article_extraction", "visible_text_regex", "semantic_extraction", "manual_fallback_failed"]
#: Attributes that a plan may read.
ATTRIBUTES = ["text", "href", "src", "srcset", "alt", "title", "class", "id", "value", "content", "datetime", "name", "type", "role", "placeholder", "download", "rel", "property", "lang"]
_NAME, _DATA = re.compile(r"^[a-z][a-z0-9_]{0,63}$"), re.compile(r"^(data-|aria-)[a-z][a-z0-9-]*$")
MOST_FIELDS, MOST_PATTERNS = 20, 10
#: As many records of a page as there can be.
ALL_RECORDS = (1 << 31) - 1
SPARK_TYPES = {"number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "list_string": T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class FieldSpec:
    """A wanted field."""

    name: str
    type: str = "string"
    required: bool = False
    description: str = ""

    def __post_init__(self) -> None:
        if not _NAME.match(self.name):
            raise ValueError(f"field name {self.name!r}")
        if self.type not in TYPES:
            raise ValueError(f"field type {self.type!r}")


@dataclass(frozen=True)
class Intent:
    """What a request wants: records of an entity with fields, one ("object") or many ("array")."""

    fields: tuple[FieldSpec, ...]
    entity: str = "record"
    expected: str = "array"
    task: str = "extract"

    def __post_init__(self) -> None:
        if not 1 <= len(self.fields) <= MOST_FIELDS or len({f.name for f in self.fields}) < len(self.fields):
            raise ValueError("an intent has 1 to 20 fields of different names")
        if self.expected not in ("array", "object"):
            raise ValueError(f"expected output {self.expected!r}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES.get(f.type, T.StringType())) for f in self.fields])

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]


@dataclass(frozen=True)
class FieldSelector:
    """Where a field's value is."""

    name: str
    selector: str = ""
    attribute: str = "text"
    fallback: str | None = None

    def __post_init__(self) -> None:
        if self.attribute not in ATTRIBUTES and not _DATA.match(self.attribute):
            raise ValueError(f"attribute {self.attribute!r}")


@dataclass(frozen=True)
class Plan:
    """How to extract: one of STRATEGIES, with what it needs."""

    strategy: str
    container: str | None = None
    fields: tuple[FieldSelector, ...] = ()
    table: str | None = None
    patterns: tuple[tuple[str, str], ...] = ()
    confidence: float = 0.0
    reason: str = ""
    rendered: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy {self.strategy!r}")

    def selector_of(self, name: str) -> FieldSelector | None:
        return next((f for f in self.fields if f.name == name), None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Plan:
        raw = json.loads(text)
        return replace(Plan(raw["strategy"]), container=raw.get("container"), fields=tuple(FieldSelector(**f) for f in raw.get("fields", ())), table=raw.get("table"), patterns=tuple(map(tuple, raw.get("patterns", ()))), confidence=raw.get("confidence", 0.0), reason=raw.get("reason", ""), rendered=raw.get("rendered", False))


@dataclass(frozen=True)
class Options:
    """Of a request; max_records of None is all of a page."""

    use_browser: str = "auto"
    max_records: int | None = 100
    save_template: bool = True
    output_format: str = "json"

    def __post_init__(self) -> None:
        if self.use_browser not in ("auto", "force", "never") or (self.max_records is not None and self.max_records < 1) or self.output_format not in ("json", "csv"):
            raise ValueError("options out of range")


def check_instruction(instruction: str) -> None:
    if not 3 <= len(instruction) <= 1000:
        raise ValueError("an instruction has 3 to 1000 characters")


__all__ = ["ATTRIBUTES", "STRATEGIES", "FieldSelector", "FieldSpec", "Intent", "Options", "Plan", "check_instruction"]
