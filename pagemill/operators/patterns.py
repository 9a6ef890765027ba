"""Regular expressions over pages' texts that always end.

A pattern is taken apart by Python's own parser. If no repetition holds another one, or alternatives, and few are open, the time of a search is
bounded by a low power of the length of the text, and the JVM runs it; any other runs under a limit of time, and a search that is stopped finds nothing and says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as codes  # the parser's own names
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that one search may take.
SECONDS = 0.05
#: Parts of patterns that the two regular expression languages read differently.
FOREIGN = ("(?P", "(?(", "\\A", "\\Z", "(?<=", "(?<!", "(?R", "(?|", "\\N", "\\L", "[[", "&&", "--", "~~", "||")
#: Repetitions of open length of one pattern that the JVM may try one within another's reach; each is one more power of the text's length.
MOST_OPEN = 3
_REPEATS = {codes.MAX_REPEAT, codes.MIN_REPEAT, getattr(codes, "POSSESSIVE_REPEAT", None)}


def _parts(tree) -> Iterator[tuple]:  # noqa: ANN001
    """Each step of a parsed pattern, with those inside it."""
    for op, arg in tree:
        yield op, arg
        for x in arg if isinstance(arg, (tuple, list)) else ():
            if isinstance(x, parser.SubPattern):
                yield from _parts(x)
            elif isinstance(x, list):
                for y in x:
                    if isinstance(y, parser.SubPattern):
                        yield from _parts(y)


def is_bounded(pattern: str) -> bool:
    """Whether the time of a search is bounded by a low power of the length of the text, whatever the text."""
    try:
        tree = parser.parse(pattern, re.IGNORECASE)
    except (re.error, RecursionError, OverflowError):
        return False
    opened = 0
    for op, arg in _parts(tree):
        if op in (codes.GROUPREF, codes.GROUPREF_EXISTS, codes.ASSERT, codes.ASSERT_NOT):
            return False
        if op in _REPEATS:
            low, high, inner = arg
            if high == low == 1:
                continue
            short, long = inner.getwidth()
            if high - low > 64 or high == codes.MAXREPEAT:
                opened += 1
            if (short != long or high > 64 and high != codes.MAXREPEAT) and (high > 1):
                return False  # what is repeated can be cut in more than one way
            if any(o is codes.BRANCH for o, _ in _parts(inner)) and high > 1:
                return False
    return opened <= MOST_OPEN


def timed_match(text: str | None, pattern: str, seconds: float = SECONDS) -> tuple[str | None, str | None]:
    """(value, what went wrong): a pattern's first group, or its whole first match if it has none; case does not count."""
    import regex

    try:
        m = regex.search(pattern, text or "", flags=regex.IGNORECASE, timeout=seconds)
    except TimeoutError:
        return None, "stopped after its time"
    except regex.error as e:
        return None, f"no pattern: {e}"
    return (m and (m.group(1) if m.re.groups else m.group(0))) or None, None


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("note", T.StringType())]))
def _timed(texts: pd.Series, patterns: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([timed_match(t, p) for t, p in zip(texts, patterns, strict=True)], columns=["value", "note"], dtype=object)


def first_match(text: Column, pattern: str) -> Column:
    """A pattern's first group, or its whole first match if it has none; null where nothing matches or the search was stopped. In the JVM if the pattern is bounded and read alike there."""
    if any(x in pattern for x in FOREIGN) or not is_bounded(pattern):
        return _timed(text, F.lit(pattern))["value"]
    found = F.regexp_extract(text, f"(?iU){pattern}", 1 if re.compile(pattern).groups else 0)
    return F.nullif(found, F.lit(""))


def match_note(text: Column, pattern: str) -> Column:
    """Why a pattern found nothing, or null."""
    if is_bounded(pattern) and not any(x in pattern for x in FOREIGN):
        return F.lit(None).cast("string")
    return _timed(text, F.lit(pattern))["note"]
