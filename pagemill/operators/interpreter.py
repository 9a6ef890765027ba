"""Plans as data: each page brings its plan as a value, and one narrow pass runs all of them.

Selectors are parsed once a worker and tried over the page's nodes, which stay in columns of numbers, tags and texts. What a plan selects comes
out raw, with notes of what went wrong; URLs, types and records are Columns over it, the same for every plan. So the plan of a job
does not grow with the number of layouts. Same results as the strategies in `strategies`, which are written for one plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import built_once, field_term, or_null
from pagemill.functions.urls import join_url
from pagemill.plans.model import ALL_RECORDS, MOST_PATTERNS, FieldSelector, Intent, Plan

from . import css, strategies
from .dom import PART_NODES, in_parts, unpack, whole_nodes
from .patterns import timed_match

#: Strategies that the interpreter runs; the others read nothing of a plan and are Columns alone.
SELECTING = ("single_dom_selector", "repeated_dom_selector", "table_extraction", "visible_text_regex")
_NUMBERS = ("pid", "last", "sib", "sibs", "kind", "kinds", "prev")
#: Rows of a page that are handed on at once, and how many such pieces.
RAW_ROWS, RAW_PIECES = 1 << 12, 4
_RAW = "struct<value:string,link:boolean,fallback:string,fallback_link:boolean>"
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")  # white space of Unicode, as functions.text.collapse has it
_WORDS = re.compile(r"[ \t\n\x0b\f\r]+")


@lru_cache(maxsize=10_000)
def _clauses(selector: str) -> list[css.Clause]:
    return css.clauses(selector)


@lru_cache(maxsize=10_000)
def _plan(text: str) -> Plan:
    return Plan.from_json(text)


def _listed(array: pa.Array) -> list:
    """The values of an array; as a whole, which is many times as fast as one by one."""
    if array.null_count and not pa.types.is_string(array.type):
        return array.to_pylist()  # numbers would become floats
    return array.to_numpy(zero_copy_only=False).tolist()


class NodeTable:
    """The nodes of the pages of a batch, a list a field; a page is a range of them."""

    def __init__(self, nodes: pa.ListArray) -> None:
        offsets = nodes.offsets.to_pylist()
        self.offsets = [o - offsets[0] for o in offsets]
        every = nodes.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.numbers = {n: _listed(every.field(n)) for n in _NUMBERS}
        self.tag, self.text, attrs = _listed(every.field("tag")), _listed(every.field("text")), every.field("attrs")
        at = _listed(attrs.offsets)
        keys, values = (_listed(x.slice(at[0], at[-1] - at[0])) for x in (attrs.keys, attrs.items))
        pairs = zip([o - at[0] for o in at], [o - at[0] for o in at[1:]], _listed(attrs.is_valid()), strict=False)
        self.attrs = [dict(zip(keys[a:b], values[a:b], strict=True)) if valid else {} for a, b, valid in pairs]


class _Attributes:
    """The attributes of nodes, as dicts that are made when they are asked for."""

    def __init__(self, attrs: pa.MapArray) -> None:
        self.at = _view(attrs.offsets)
        self.keys, self.values = _shared(attrs.keys), _shared(attrs.items)

    def __getitem__(self, n: int | slice) -> dict[str, str] | _Attributes:
        if isinstance(n, slice):
            return self
        a, b = self.at[n], self.at[n + 1]
        return dict(zip(self.keys[a:b], self.values[a:b], strict=True))


def _view(numbers: pa.Array) -> memoryview:
    """Numbers as they lie in memory, four bytes each."""
    return memoryview(numbers.to_numpy(zero_copy_only=False).astype("i", copy=False))


def _shared(array: pa.Array) -> list[str | None]:
    """Strings, of which equal ones are held once."""
    coded = array.dictionary_encode()
    words = [*coded.dictionary.to_pylist(), None]
    return [words[i] for i in memoryview(pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False))]


class LongPage:
    """A NodeTable of one page that came packed: numbers, names and attributes take some tenth of what lists of them do."""

    def __init__(self, packed: pa.Buffer) -> None:
        nodes = unpack(packed, (*_NUMBERS, "tag", "attrs", "text"))
        self.offsets = [0, len(nodes)]
        self.numbers = {n: _view(nodes.field(n)) for n in _NUMBERS}
        self.tag, self.text, self.attrs = _shared(nodes.field("tag")), _shared(nodes.field("text")), _Attributes(nodes.field("attrs"))


class PageNodes:
    """One page of a NodeTable; a node is its number."""

    def __init__(self, table: NodeTable | LongPage, page: int) -> None:
        a, b = table.offsets[page], table.offsets[page + 1]
        self.size = b - a
        self.tag, self.attrs, self.texts = table.tag[a:b], table.attrs[a:b], table.text[a:b]
        for n, values in table.numbers.items():
            setattr(self, n, values[a:b])

    def text(self, n: int | None, separator: str = "") -> str:
        if n is None:
            return ""
        own = separator.join(self.texts[i] or "" for i in range(n, self.last[n] + 1) if self.tag[i] == "#text")
        return _SPACE.sub(" ", own).strip(" ")

    def matches(self, n: int, c: css.Compound) -> bool:
        if self.tag[n].startswith("#") or c.tag not in ("*", self.tag[n]):
            return False
        return all(self._test(n, *t) for t in c.tests)

    def _test(self, n: int, kind: str, *rest) -> bool:  # noqa: ANN002
        own = self.attrs[n]
        if kind == "id":
            return own.get("id") == rest[0]
        if kind == "class":
            return rest[0] in _WORDS.split(own.get("class", ""))
        if kind == "attribute":
            name, op, want = rest
            value = own.get(name)
            if value is None:
                return False
            if op in ("^=", "$=", "*=") and not want:
                return False
            return {"": lambda: True, "=": lambda: value == want, "~=": lambda: want in _WORDS.split(value), "|=": lambda: value == want or value.startswith(f"{want}-"), "^=": lambda: value.startswith(want), "$=": lambda: value.endswith(want), "*=": lambda: want in value}[op]()
        if kind == "only":
            return getattr(self, rest[0])[n] == 1
        if kind == "not":
            return not self.matches(n, rest[0])
        if kind == "contains":
            return rest[0] in self.text(n, " ")
        at, of = (self.kind, self.kinds) if kind.endswith("of-type") else (self.sib, self.sibs)
        place, (step, offset) = of[n] - at[n] + 1 if "last" in kind else at[n], rest
        return place == offset if not step else (place - offset) % step == 0 and (place - offset) / step >= 0

    def _matched(self, c: css.Clause, begin: int, end: int) -> list[int]:
        found = [n for n in range(begin, end) if self.matches(n, c[0][1])]
        for combinator, own in c[1:]:
            if combinator == " ":
                after, upto = [], -1
                for a in found:
                    if a > upto:  # the outermost ones; those inside them add nothing
                        upto = self.last[a]
                        after += [n for n in range(a + 1, min(upto + 1, end)) if self.matches(n, own)]
                found = after
            elif combinator == "~":
                first: dict[int, int] = {}
                for a in found:
                    first[self.pid[a]] = min(self.sib[a], first.get(self.pid[a], self.sib[a]))
                found = [n for n in range(begin, end) if self.sib[n] > first.get(self.pid[n], 1 << 31) and self.matches(n, own)]
            else:
                to, ids = self.pid if combinator == ">" else self.prev, set(found)
                found = [n for n in range(begin, end) if to[n] in ids and self.matches(n, own)]
        return found

    def select(self, selector: str, begin: int, end: int, most: int = css.MOST) -> list[int]:
        """The nodes in a range that a selector yields, in the order of css.select_all."""
        out: list[int] = []
        for c in _clauses(selector):
            found = self._matched(c, begin, end)
            if any(x.contains for _, x in c):
                found.sort(key=lambda n: (len(self.text(n, " ")), n))
            out += found
        return out[:most]

    def read(self, selector: str, attribute: str, begin: int, end: int, whole: int) -> tuple[str | None, bool]:
        """(value, whether it is a link) of the first node that a selector yields, or of the node `whole` for an empty one."""
        if selector:
            try:
                n = next(iter(self.select(selector, begin, end)), None)
            except css.InvalidSelectorError:
                n = None
        else:
            n = whole if self.size else None
        if attribute == "text":
            return self.text(n), False
        value = None if n is None else self.attrs[n].get(attribute)
        return value and value.strip(" "), attribute in ("href", "src")

    def field(self, s: FieldSelector | None, begin: int, end: int, whole: int) -> dict:
        if s is None:
            return {}
        value, link = self.read(s.selector, s.attribute, begin, end, whole)
        fallback, fallback_link = self.read(s.fallback, s.attribute, begin, end, whole) if s.fallback else (None, False)
        return {"value": value, "link": link, "fallback": fallback, "fallback_link": fallback_link}


def _single(page: PageNodes, plan: Plan, names: list[str], most: int, notes: list[str]) -> list[list[dict]]:
    return [[page.field(plan.selector_of(n), 0, page.size, 0) for n in names]]


def _repeated(page: PageNodes, plan: Plan, names: list[str], most: int, notes: list[str]) -> Iterable[list[dict]]:
    try:
        found = page.select(plan.container or "", 0, page.size, most)
    except css.InvalidSelectorError as e:
        notes.append(f"container: {e}")
        return []
    if not found:
        notes.append("container: nothing matches")
    selectors = [plan.selector_of(n) for n in names]
    # A selector looks below a container; without one a field is the container itself.
    return ([page.field(s, c + 1 if s and s.selector else c, page.last[c] + 1, c) for s in selectors] for c in found)


def _table(page: PageNodes, plan: Plan, names: list[str], most: int, notes: list[str]) -> list[list[dict]]:
    try:
        found = page.select(plan.table or plan.container or "table", 0, page.size)[:1]
    except css.InvalidSelectorError as e:
        found = []
        notes.append(f"table: {e}")
    if not found:
        notes.append("table: nothing matches")
        return []
    below = lambda n, *tags: [m for m in range(n + 1, page.last[n] + 1) if page.tag[m] in tags]
    rows = [cells for tr in below(found[0], "tr") if (cells := below(tr, "td", "th"))]
    if not rows:
        return []
    head = [page.text(c).lower() for c in rows[0]]
    body = rows[1:] if any(page.tag[c] == "th" for c in rows[0]) else rows
    places = []
    for name in names:
        term = field_term(name).lower()
        near = (i for i, h in enumerate(head) if h and (term in h or h in term))
        places.append(head.index(term) if term in head else next(near, None))
        if places[-1] is None:
            notes.append(f"table: no column for {name}")
    return [[{} if p is None or p >= len(r) else {"value": page.text(r[p]), "link": False} for p in places] for r in body]


def _patterns(page: PageNodes, plan: Plan, names: list[str], most: int, notes: list[str]) -> list[list[dict]]:
    body = next((n for n in range(page.size) if page.tag[n] == "body"), None)
    text = page.text(body) if body is not None else _SPACE.sub(" ", "".join(t or "" for t, g in zip(page.texts, page.tag, strict=True) if g == "#text")).strip(" ")
    patterns, row = dict(plan.patterns[:MOST_PATTERNS]), []
    for n in names:
        value, wrong = timed_match(text, patterns[n]) if n in patterns else (None, None)
        if wrong:
            notes.append(f"pattern of {n}: {wrong}")
        row.append({"value": value, "link": False})
    return [row]


_RUN = dict(zip(SELECTING, (_single, _repeated, _table, _patterns), strict=True))


def selected(pages: DataFrame, intent: Intent, most: int) -> DataFrame:
    """page_id, url, raw (rows of fields as the plan's selectors yield them), at (the place of the first of these) and notes of pages (page_id, url,
    nodes, plan and perhaps packed, see `dom.parse_pages`) whose plan has one of SELECTING. A page whose plan can't be read has a note. Pages of many
    rows come in pieces of RAW_ROWS; the first has the notes."""
    names = [f.name for f in intent.fields]
    raw_type = pa.list_(pa.list_(pa.struct([("value", pa.string()), ("link", pa.bool_()), ("fallback", pa.string()), ("fallback_link", pa.bool_())])))
    packed = "packed" in pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a long page is worked on by itself: its nodes are many more than those that are shown
            sizes = pc.fill_null(pc.list_value_length(batch.column("nodes")), 0).to_pylist()
            long = batch.column("packed").is_valid().to_pylist() if packed else [False] * len(sizes)
            for a, b in in_parts([size + 2 * PART_NODES * is_long for size, is_long in zip(sizes, long, strict=True)], PART_NODES):
                part = batch.slice(a, b - a)
                table = LongPage(part.column("packed")[0].as_buffer()) if long[a] else NodeTable(part.column("nodes"))
                rows, raws, firsts, noted = [], [], [], []
                for i, text in enumerate(part.column("plan").to_pylist()):
                    notes: list[str] = []
                    try:
                        plan = _plan(text)
                        found = iter(_RUN[plan.strategy](PageNodes(table, i), plan, names, most, notes))
                        pieces = [pa.array([piece], raw_type) for piece in iter(lambda: list(islice(found, RAW_ROWS)), [])]  # noqa: B023
                    except (ValueError, KeyError, TypeError) as e:
                        pieces = []
                        notes.append(f"plan: {e}"[:200])
                    pieces = pieces or [pa.array([[]], raw_type)]
                    raws += pieces
                    rows += [i] * len(pieces)
                    firsts += [k * RAW_ROWS for k in range(len(pieces))]
                    noted += [notes, *([[]] * (len(pieces) - 1))]
                # few pieces at a time, so that Spark gets no large arrays of bytes either
                for k in range(0, len(rows), RAW_PIECES):
                    end = k + RAW_PIECES
                    own = pa.array(rows[k:end], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("page_id").take(own), part.column("url").take(own), pa.concat_arrays(raws[k:end]), pa.array(firsts[k:end], pa.int32()), pa.array(noted[k:end], pa.list_(pa.string()))], ["page_id", "url", "raw", "at", "notes"])

    kind = pages.schema["page_id"].dataType.simpleString()
    lean = F.transform("nodes", lambda n: F.struct(*(n[c].alias(c) for c in (*_NUMBERS, "tag", "attrs", "text"))))
    return pages.select("page_id", "url", lean.alias("nodes"), "plan", *(["packed"] if packed else [])).mapInArrow(run, f"page_id {kind}, url string, raw array<array<{_RAW}>>, at int, notes array<string>")


@built_once
def _values() -> Column:
    """Of each field what its selector yields, else what its fallback does; links are made absolute."""
    both = lambda f: F.array(F.struct(f["value"].alias("v"), f["link"].alias("l")), F.struct(f["fallback"].alias("v"), f["fallback_link"].alias("l")))
    whole = lambda c: or_null(F.when(c["l"], join_url(F.col("url"), c["v"])).otherwise(c["v"]))
    return F.transform("fields", lambda f: F.get(F.filter(F.transform(both(f), whole), lambda v: v.isNotNull()), F.lit(0)))


def records_of(found: DataFrame, intent: Intent, most: int) -> DataFrame:
    """Records of what `selected` found, normalised by type as the strategies' are."""
    rows = found.select("page_id", "url", "at", F.posexplode("raw").alias("row_idx", "fields")).withColumn("row_idx", F.col("at") + F.col("row_idx")).drop("at").withColumn("values", _values())
    return strategies._rows(rows, intent, {f.name: strategies._normal(F.get("values", F.lit(i)), f.type, F.col("url")) for i, f in enumerate(intent.fields)}, most)


def strategies_in(pages: DataFrame) -> set[str]:
    """The strategies of the pages' plans; there are eight."""
    return {r.s for r in pages.select(F.get_json_object("plan", "$.strategy").alias("s")).distinct().collect()}


def run_plans(pages: DataFrame, intent: Intent, most: int = ALL_RECORDS, present: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, notes) of pages (page_id, url, nodes, embedded and plan, as JSON): a record table as the strategies give it, and (page_id, notes).

    One pass for all plans that select, and one for each of the other strategies that occur (`present`, if the caller knows them).
    """
    present = strategies_in(pages) if present is None else present
    of = F.get_json_object("plan", "$.strategy")
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    records = spark.createDataFrame([], strategies.NO_RECORDS.replace("page_id long", f"page_id {kind}"))
    notes = spark.createDataFrame([], f"page_id {kind}, notes array<string>")
    if present & {*SELECTING}:
        from .staging import staged

        found = staged(selected(pages.where(of.isin(*SELECTING)), intent, most))
        records = records_of(found, intent, most)
        notes = found.where(F.size("notes") > 0).select("page_id", "notes")
    for name in sorted((present & {*strategies.STRATEGY}) - {*SELECTING}):
        own = whole_nodes(pages.where(of == name))
        if name == "semantic_extraction" and "facts" not in pages.columns:
            from .page import facts

            own = own.withColumn("facts", facts(F.col("nodes"), F.col("url"), F.col("embedded")))
        records = records.unionByName(strategies.STRATEGY[name](own, Plan(name), intent, most))
    return records, notes
