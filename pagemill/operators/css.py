"""CSS selectors compiled, on the driver, to Column predicates over nodes.

Grammar: tag, *, #id, .class, [a], [a op 'v'] with = ~= |= ^= $= *=, :first-child and the like, :nth-child(an+b),
:nth-of-type(an+b), :not(simple), :contains('text') on any compound; combinators descendant, >, + and ~; commas. A
clause with anything else selects nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dom

#: Nodes that one selector yields at most, and the longest selector that is read.
MOST, LONGEST = 500, 500


class InvalidSelectorError(ValueError):
    """A selector that is empty or too long."""


class Unsupported(ValueError):
    """A clause with a pseudo-class that is not in the grammar, or that is no selector at all."""


@dataclass
class Compound:
    tag: str = "*"
    tests: list[tuple] = field(default_factory=list)

    @property
    def contains(self) -> list[str]:
        return [t[1] for t in self.tests if t[0] == "contains"]


#: A clause: its compounds from left to right, each with the combinator that stands before it.
Clause = list[tuple[str, Compound]]
_NAME = re.compile(r"(?:\\.|[\w-]|[^\x00-\x7f])+")
_ATTRIBUTE = re.compile(r"\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$")
_SIMPLE = {"first-child": ("nth-child", 0, 1), "last-child": ("nth-last-child", 0, 1), "only-child": ("only", "sibs"), "first-of-type": ("nth-of-type", 0, 1), "last-of-type": ("nth-last-of-type", 0, 1), "only-of-type": ("only", "kinds")}


def split_outside(text: str, separators: str) -> list[str]:
    """The parts of a text between separators that lie outside quotes and brackets."""
    parts, held, quote, depth = [], "", "", 0
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch in separators and not depth:
            parts.append(held)
            held = ""
            continue
        held += ch
    return [*parts, held]


def _argument(text: str, at: int) -> tuple[str, int]:
    """What stands in the parentheses that open at `at`, and the place behind them."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
    raise Unsupported(text)


def _nth(text: str) -> tuple[int, int]:
    m = _NTH.match(text.lower())
    if not m:
        raise Unsupported(text)
    if m[1]:
        return 2, 1 if m[1] == "odd" else 0
    if m[5]:
        return 0, int(m[5])
    step = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
    return step, int((m[3] or "+") + (m[4] or "0"))


def compound(text: str, *, simple: bool = False) -> Compound:
    out, at = Compound(), 0
    if m := _NAME.match(text):
        out.tag, at = m[0].lower(), m.end()
    elif text.startswith("*"):
        at = 1
    start = at
    while at < len(text):
        ch = text[at]
        if ch in "#." and (m := _NAME.match(text, at + 1)):
            out.tests.append(("id" if ch == "#" else "class", re.sub(r"\\(.)", r"\1", m[0])))
            at = m.end()
        elif ch == "[" and (m := _ATTRIBUTE.match(text, at)):
            value = next((v for v in m.groups()[2:] if v is not None), "")
            out.tests.append(("attribute", m[1].lower(), m[2] or "", value))
            at = m.end()
        elif ch == ":" and not text.startswith("::", at) and (m := _NAME.match(text, at + 1)):
            name, at = m[0].lower(), m.end()
            argument = None
            if at < len(text) and text[at] == "(":
                argument, at = _argument(text, at)
            if name in _SIMPLE and argument is None:
                out.tests.append(_SIMPLE[name])
            elif name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type") and argument is not None:
                out.tests.append((name, *_nth(argument)))
            elif name == "contains" and argument is not None:
                out.tests.append(("contains", " ".join(argument.strip().strip("'\"").split())))
            elif name == "not" and argument is not None and not simple:
                out.tests.append(("not", compound(argument.strip(), simple=True)))
            else:
                raise Unsupported(f":{name}")
        else:
            raise Unsupported(text)
    if not text or start == 0 and not out.tests and out.tag == "*" and text != "*":
        raise Unsupported(text)
    return out


def clause(text: str) -> Clause:
    spaced = "".join(split_spaced(text))
    out: Clause = []
    before = " "
    for word in split_outside(spaced, " \t\n\r\f"):
        if not word:
            continue
        if word in (">", "+", "~"):
            if before != " ":
                raise Unsupported(text)
            before = word
        else:
            out.append((before, compound(word)))
            before = " "
    if not out or before != " ":
        raise Unsupported(text)
    return out


def split_spaced(text: str) -> list[str]:
    """The text with a space on either side of each combinator outside quotes and brackets."""
    out, quote, depth = [], "", 0
    for ch in text.strip():
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        out.append(f" {ch} " if ch in ">+~" and not quote and not depth else ch)
    return out


def clauses(selector: str) -> list[Clause]:
    """The clauses that can be evaluated; the others are left out."""
    if not selector.strip():
        raise InvalidSelectorError("empty selector")
    if len(selector) > LONGEST:
        raise InvalidSelectorError(f"selector of over {LONGEST} characters")
    out = []
    for part in split_outside(selector, ","):
        try:
            out.append(clause(part))
        except Unsupported:
            continue
    return out


def _place(at: Column, step: int, offset: int) -> Column:
    if not step:
        return at == offset
    return ((at - offset) % step == 0) & ((at - offset) / step >= 0)


def matches(n: Column, c: Compound, nodes: Column) -> Column:
    """Whether a node is what a compound describes."""
    out = dom.is_element(n) if c.tag == "*" else n["tag"] == c.tag
    value = lambda name: F.coalesce(F.element_at(n["attrs"], F.lit(name)), F.lit(""))
    has = lambda name: F.element_at(n["attrs"], F.lit(name)).isNotNull()
    words = lambda name: F.split(value(name), r"\s+")
    for kind, *rest in c.tests:
        if kind == "id":
            test = has("id") & (value("id") == rest[0])
        elif kind == "class":
            test = F.array_contains(words("class"), rest[0])
        elif kind == "attribute":
            name, op, want = rest
            own = value(name)
            test = has(name) & {
                "": F.lit(True),
                "=": own == want,
                "~=": F.array_contains(words(name), want),
                "|=": (own == want) | own.startswith(f"{want}-"),
                "^=": own.startswith(want) & F.lit(want != ""),
                "$=": own.endswith(want) & F.lit(want != ""),
                "*=": own.contains(want) & F.lit(want != ""),
            }[op]
        elif kind == "only":
            test = n[rest[0]] == 1
        elif kind == "not":
            test = ~matches(n, rest[0], nodes)
        elif kind == "contains":
            test = dom.text_of(nodes, n, " ").contains(rest[0])
        else:
            at, of = ("kind", "kinds") if kind.endswith("of-type") else ("sib", "sibs")
            test = _place(n[of] - n[at] + 1 if "last" in kind else n[at], *rest)
        out = out & test
    return F.coalesce(out, F.lit(False))


def _numbers(found: Column) -> Column:
    return F.transform(found, lambda n: n["nid"])


def _outermost(found: Column) -> Column:
    """Of nodes in document order those that lie within no other of them, by number."""
    step = lambda s, n: F.when(n["nid"] > s["last"], F.struct(n["last"].alias("last"), F.concat(s["ids"], F.array(n["nid"])).alias("ids"))).otherwise(s)
    return F.aggregate(found, F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("ids")), step, lambda s: s["ids"])


def _matched(nodes: Column, c: Clause) -> Column:
    """The nodes that a clause yields, in document order: those of its first compound, then from step to step those that its combinators lead to.

    A step costs the nodes below the outermost ones found so far, or a look-up of each node's parent or sibling.
    """
    found = F.filter(nodes, lambda n: dom.is_element(n) & matches(n, c[0][1], nodes))
    for combinator, own in c[1:]:
        found = _step(nodes, found, combinator, own)
    return found


def _step(nodes: Column, found: Column, combinator: str, own: Compound) -> Column:
    if combinator == " ":
        tops = F.transform(_outermost(found), lambda i: dom.node_at(nodes, i))
        return F.flatten(F.transform(tops, lambda a: F.filter(dom.below(nodes, a), lambda n: dom.is_element(n) & matches(n, own, nodes))))
    if combinator == "~":  # the first that was found among the children of a parent decides for all behind it
        return dom.let(found, lambda before: F.filter(nodes, lambda n: dom.is_element(n) & matches(n, own, nodes) & F.exists(before, lambda a: (a["pid"] == n["pid"]) & (a["sib"] < n["sib"]))))
    to = "pid" if combinator == ">" else "prev"
    return dom.let(_numbers(found), lambda ids: F.filter(nodes, lambda n: dom.is_element(n) & matches(n, own, nodes) & F.array_contains(ids, n[to])))


def select_all(nodes: Column, selector: str, most: int = MOST) -> Column:
    """The nodes that a selector yields: clause by clause, each in document order, or by length of text where a clause has :contains."""
    length = lambda n: F.length(dom.text_of(nodes, n, " "))
    found = []
    for c in clauses(selector):
        own = _matched(nodes, c)
        if any(x.contains for _, x in c):
            own = F.transform(F.array_sort(F.transform(own, lambda n: F.struct(length(n).alias("size"), n["nid"].alias("nid"), n.alias("node"))), lambda a, b: F.when(a["size"] != b["size"], a["size"] - b["size"]).otherwise(a["nid"] - b["nid"])), lambda x: x["node"])
        found.append(own)
    if not found:
        return F.filter(nodes, lambda n: F.lit(False))
    return F.slice(F.concat(*found) if len(found) > 1 else found[0], 1, most)


def select_first(nodes: Column, selector: str) -> Column:
    """The first of them, or null; also for a selector that is empty or too long."""
    try:
        return dom.first(select_all(nodes, selector))
    except InvalidSelectorError:
        return dom.first(F.filter(nodes, lambda n: F.lit(False)))
