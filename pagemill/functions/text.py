"""Strings: white space, names and numbers in text."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")
#: Fixed value: what looks like a price.
PRICE = r"[$€£¥]\s?\d|\d+[.,]\d{2}"


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode) to a space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, not wherever body or a lambda within it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(build: Callable[[], T]) -> Callable[[], T]:
    """Columns that are the same whenever they are asked for, built once in a JVM: building is a call to it for each part of an expression."""
    held: dict[int, T] = {}

    def get() -> T:
        from pyspark import SparkContext

        key = id(SparkContext._gateway)
        if key not in held:
            held.clear()
            held[key] = build()
        return held[key]

    return get


def or_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def field_term(name: str) -> str:
    return name.replace("_", " ")


def to_pascal(name: str) -> str:
    return "".join(part[:1].upper() + part[1:].lower() for part in name.split("_"))


def to_camel(name: str) -> str:
    pascal = to_pascal(name)
    return pascal[:1].lower() + pascal[1:]


def key_variants(name: str) -> list[str]:
    """The spellings under which JSON may hold a field, in order of preference."""
    return list(dict.fromkeys([name, name.replace("_", ""), name.replace("_", "-"), to_camel(name), to_pascal(name)]))


def has_price(text: Column) -> Column:
    return text.rlike(PRICE)


def goal_signature(field_names: Column) -> Column:
    """Sixteen hex digits that name a set of fields, in any order, case and punctuation."""
    clean = F.transform(field_names, lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", ""))
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(clean)), "|"), 256), 1, 16)


def idempotency_key(url: Column, instruction: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", url, instruction), 256), 1, 32)


def escape_class(name: Column) -> Column:
    return F.regexp_replace(name, r"([^A-Za-z0-9_-])", r"\\$1")


def selector_of(tag: Column, classes: Column) -> Column:
    """tag.class.class of at most CLASSES_IN_SELECTOR classes."""
    return F.concat(tag, F.array_join(F.transform(F.slice(classes, 1, CLASSES_IN_SELECTOR), lambda c: F.concat(F.lit("."), escape_class(c))), ""))


#: How many classes a selector names, the longest class that it may name, and class names that a page's state or build puts there.
CLASSES_IN_SELECTOR, LONGEST_CLASS = 3, 30
UNSTABLE_CLASS = r"^(is-|has-|active|selected|hover|open|expanded|focused|css-[a-z0-9]+|sc-[a-z0-9]+|jsx-\d+|\d+)$"


def stable_classes(class_attribute: Column) -> Column:
    """The lower-cased class names that are neither state, nor generated, nor over 30 characters; distinct and sorted."""
    names = F.split(F.lower(F.coalesce(class_attribute, F.lit(""))), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(names, lambda c: (c != "") & (F.length(c) <= LONGEST_CLASS) & ~c.rlike(UNSTABLE_CLASS))))
