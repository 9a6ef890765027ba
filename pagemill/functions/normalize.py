"""Typed normalisation of field values, and the checks on values, as Column expressions over strings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import collapse, let, or_null
from .urls import join_url

#: Number, currency, e-mail and boolean spellings, and longest plausible values by type.
NUMBER, INTEGER = r"-?\d+(?:[.,]\d+)?", r"-?\d+"
CURRENCY = r"[$€£¥₹]\s?-?\d+(?:[.,]\d+)?|-?\d+(?:[.,]\d+)?\s?[$€£¥₹]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TRUE, FALSE = ["true", "yes", "1", "in stock", "available"], ["false", "no", "0", "out of stock", "unavailable"]
BOOLEAN = ["true", "false", "yes", "no", "0", "1"]
LONGEST = {"string": 4000, "number": 30, "integer": 20, "currency": 60, "url": 500, "email": 254, "phone": 30, "date": 60, "boolean": 10, "list_string": 4000}
MONTHS = {m: i + 1 for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}
TYPES = list(LONGEST)


def number(text: Column) -> Column:
    return F.regexp_replace(or_null(F.regexp_extract(text, NUMBER, 0)), ",", ".").try_cast("double")


def integer(text: Column) -> Column:
    return or_null(F.regexp_extract(text, INTEGER, 0)).try_cast("bigint")


def currency(text: Column) -> Column:
    """The number with its symbol, or else the whole text."""
    return let(collapse(text), lambda clean: F.coalesce(or_null(F.trim(F.regexp_extract(clean, CURRENCY, 0))), or_null(clean)))


def email(text: Column) -> Column:
    return or_null(F.regexp_extract(text, EMAIL, 0))


def phone(text: Column) -> Column:
    return let(F.regexp_replace(text, r"\D", ""), lambda digits: F.when(F.length(digits).between(7, 15), digits))


def boolean(text: Column) -> Column:
    return let(F.lower(collapse(text)), lambda low: F.when(low.isin(TRUE), True).when(low.isin(FALSE), False))


def list_string(text: Column) -> Column:
    return F.filter(F.transform(F.split(collapse(text), "[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def url(text: Column, base: Column) -> Column:
    return let(join_url(base, collapse(text)), lambda out: F.when(out.rlike("^(?i)https?:"), out))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(F.concat_ws("-", year, month, day).try_cast("date"), "yyyy-MM-dd")


def common_date(text: Column) -> Column:
    """An ISO date of the customary ways to write one in full; null for all others."""
    return let(collapse(text), _common_date)


def _common_date(clean: Column) -> Column:
    names = F.create_map(*(x for name, i in MONTHS.items() for x in (F.lit(name), F.lit(str(i)))))
    month = lambda pattern, g: F.element_at(names, F.lower(F.substring(F.regexp_extract(clean, pattern, g), 1, 3)))
    one = lambda pattern, g: or_null(F.regexp_extract(clean, pattern, g))
    iso, named, day_first = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?$", r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$", r"^(\d{1,2}) ([A-Za-z]{3,9})\.?,? (\d{4})$"
    return F.coalesce(
        F.when(clean.rlike(iso), _iso(one(iso, 1), one(iso, 2), one(iso, 3))),
        F.when(clean.rlike(named), _iso(one(named, 3), month(named, 1), one(named, 2))),
        F.when(clean.rlike(day_first), _iso(one(day_first, 3), month(day_first, 2), one(day_first, 1))),
    )


@F.pandas_udf(T.StringType())
def _fuzzy_date(texts: pd.Series) -> pd.Series:
    from datetime import datetime

    from dateutil import parser

    default = datetime(2000, 1, 1)  # parts that a text leaves out

    def parse(text: str | None) -> str | None:
        try:
            return parser.parse(text, fuzzy=True, default=default).date().isoformat() if text else None
        except (ValueError, OverflowError, TypeError):
            return None

    return texts.map(parse)


def date(text: Column) -> Column:
    """An ISO date; texts that are no customary date go to a fuzzy parser, and only those."""
    fast = common_date(text)
    return F.coalesce(fast, _fuzzy_date(F.when(fast.isNull(), text)))


def normalize(text: Column, kind: str, base: Column | None = None, *, fuzzy_dates: bool = False) -> Column:
    """A value as a string, normalised by its type; null if it is none. Lists are joined with "; "."""
    if kind == "date" and fuzzy_dates:  # a UDF has no place in a lambda
        return date(text)
    return let(collapse(text), lambda clean: or_null(_by_type(clean, kind, base)))


def _by_type(clean: Column, kind: str, base: Column | None) -> Column:
    by_type: dict[str, Callable[[], Column]] = {
        "string": lambda: clean,
        "number": lambda: number(clean).cast("string"),
        "integer": lambda: integer(clean).cast("string"),
        "currency": lambda: currency(clean),
        "url": lambda: url(clean, F.lit("") if base is None else base),
        "email": lambda: email(clean),
        "phone": lambda: phone(clean),
        "date": lambda: common_date(clean),
        "boolean": lambda: boolean(clean).cast("string"),
        "list_string": lambda: F.array_join(list_string(clean), "; "),
    }
    return by_type[kind]()


def present(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


#: Fixed value: how a decimal number may be written, once a comma counts as the point.
DECIMAL = r"(?i)^[+-]?(\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(e[+-]?\d+)?$|^[+-]?(inf|infinity|s?nan\d*)$"


def parses_as(value: Column, kind: str, *, fuzzy_dates: bool = False) -> Column:
    """Whether a present value is one of its type, length included; false for null. fuzzy_dates: dates in any wording count, by a UDF, so not within a lambda."""
    text = F.trim(value)
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    checks = {
        "string": lambda: F.lit(True),
        "list_string": lambda: F.lit(True),
        "number": lambda: F.replace(text, F.lit(","), F.lit(".")).rlike(DECIMAL),
        "integer": lambda: text.rlike(r"^-?\d+$"),
        "currency": lambda: text.rlike(NUMBER),
        "url": lambda: text.rlike("^(?i)https?:"),
        "email": lambda: text.rlike(f"^{EMAIL}$"),
        "phone": lambda: digits.between(7, 15),
        "date": lambda: (date(text) if fuzzy_dates else common_date(text)).isNotNull(),
        "boolean": lambda: F.lower(text).isin(BOOLEAN),
    }
    return F.coalesce(checks[kind]() & (F.length(value) <= LONGEST[kind]), F.lit(False))


def length_of(value: Column, kind: str) -> Column:
    """The length that a merge compares: of a list (joined by "; ") that of its parts."""
    return F.length(F.replace(value, F.lit("; "), F.lit(""))) if kind == "list_string" else F.length(value)


def plausible(value: Column, kind: str) -> Column:
    """Whether a merge may take a value: present, not too long, a URL with a host, a boolean one of its spellings."""
    checks = {"url": lambda: value.rlike("^(?i)https?://[^/?#]"), "boolean": lambda: F.lower(value).isin(BOOLEAN)}
    return present(value) & (length_of(value, kind) <= LONGEST[kind]) & checks.get(kind, lambda: F.lit(True))()


#: Types of which the semantic pass is believed first.
SEMANTIC_FIRST = ["url", "integer", "number", "currency", "date", "email", "phone"]


def pick_field(standard: Column, semantic: Column, kind: str) -> Column:
    """One of two values: the plausible semantic one for SEMANTIC_FIRST types, else the shortest plausible (ties: standard), else the first that is there."""
    s, m = F.when(plausible(standard, kind), standard), F.when(plausible(semantic, kind), semantic)
    shortest = F.when(s.isNull(), m).when(m.isNull(), s).when(length_of(m, kind) < length_of(s, kind), m).otherwise(s)
    best = F.coalesce(m, shortest) if kind in SEMANTIC_FIRST else shortest
    return F.coalesce(best, F.when(present(standard), standard), F.when(present(semantic), semantic))
