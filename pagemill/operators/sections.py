"""Repeated sections: groups of similar siblings that look like records, best first.

Groups are known from parsing (the siblings of one tag and the same stable classes); what is asked of them is worked out within
the page's row, cheap questions first, so nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import has_price, let, selector_of, stable_classes

from . import dom
from .dom import LEAST_ALIKE, SKIP

#: The gates of a group, how many of it are looked at, and how many groups are kept.
LEAST_CHILDREN, LEAST_SIMILAR, SAMPLE, FEW, DEPTH, TOP = 2.0, 0.55, 10, 5, 4, 5
NO_SECTIONS = "array<struct<selector:string,count:bigint,avg_text_length:double,sample_texts:array<string>,confidence:double>>"


def similarity(prints: Column) -> Column:
    """The mean Jaccard similarity of all pairs of an array of sets; 1 for fewer than two."""
    either = lambda a, b, both: both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))
    one = lambda a, b: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(F.size(F.array_intersect(a, b)), lambda both: either(a, b, both)))
    pairs = F.flatten(F.transform(prints, lambda a, i: F.transform(F.filter(prints, lambda b, j: j > i), lambda b: one(a, b))))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs))


def score(count: Column, similar: Column, children: Column, link: Column, price: Column, image: Column) -> Column:
    flag = lambda c: c.cast("double")
    return 0.30 * F.least(count / 20, F.lit(1.0)) + 0.30 * similar + 0.15 * F.least(children / 6, F.lit(1.0)) + 0.10 * flag(link) + 0.10 * flag(price) + 0.05 * flag(image)


def _members(nodes: Column, n: Column) -> Column:
    """The first SAMPLE siblings of a group, from its first one on."""
    more = lambda held: dom.let(dom.node_at(nodes, F.get(held, F.size(held) - 1)), lambda m: F.when(m["like_next"] < 0, held).otherwise(F.concat(held, F.array(m["like_next"]))))
    ids = F.when(n["nid"].isNotNull(), F.aggregate(F.sequence(F.lit(2), F.lit(SAMPLE)), F.array(n["nid"]), lambda held, _: more(held)))
    return F.transform(ids, lambda i: dom.node_at(nodes, i))


def _print(nodes: Column, m: Column) -> Column:
    """What elements a node holds how deep, at most DEPTH down, as a set of strings."""
    live = F.filter(dom.below(nodes, m), lambda x: dom.is_element(x) & ~x["tag"].isin(SKIP) & (x["depth"] <= m["depth"] + DEPTH))
    return F.array_distinct(F.transform(live, lambda x: F.concat(x["tag"], F.lit(" "), (x["depth"] - m["depth"]).cast("string"))))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def sections_of(nodes: Column) -> Column:
    """At most five sections, best first: struct(selector, count, avg_text_length, sample_texts, confidence). Null for null nodes."""
    firsts = F.filter(nodes, lambda n: (n["like"] == 1) & (n["likes"] >= LEAST_ALIKE) & ~n["nav"] & ~n["tag"].isin(SKIP) & (F.abs(n["alike"] - n["likes"]) <= F.greatest(F.lit(1), F.floor(n["likes"] * 0.05))))
    groups = F.transform(firsts, lambda n: F.struct(n.alias("n"), _members(nodes, n).alias("ms")))
    groups = F.transform(groups, lambda g: F.struct(g["n"].alias("n"), g["ms"].alias("ms"), _mean(F.transform(g["ms"], lambda m: m["kids"])).alias("children")))
    groups = F.filter(groups, lambda g: g["children"] >= LEAST_CHILDREN)
    groups = F.transform(groups, lambda g: F.struct(g["n"].alias("n"), g["ms"].alias("ms"), g["children"].alias("children"), dom.let(F.transform(g["ms"], lambda m: _print(nodes, m)), similarity).alias("similar")))
    groups = F.filter(groups, lambda g: g["similar"] >= LEAST_SIMILAR)

    def measured(g: Column, texts: Column) -> Column:
        few = F.slice(g["ms"], 1, FEW)
        has = lambda tag: F.exists(few, lambda m: F.exists(dom.below(nodes, m), lambda x: x["tag"] == tag))
        count = g["n"]["likes"].cast("long")
        confidence = score(count, g["similar"], g["children"], has("a"), F.exists(F.slice(texts, 1, FEW), has_price), has("img"))
        classes = stable_classes(F.element_at(g["n"]["attrs"], F.lit("class")))
        return F.struct(
            (-confidence).alias("rank"), g["n"]["pid"].alias("pid"), selector_of(g["n"]["tag"], classes).alias("selector"), count.alias("count"),
            _mean(F.transform(texts, lambda t: F.length(t))).alias("avg_text_length"), F.transform(F.slice(texts, 1, 2), lambda t: F.substring(t, 1, 200)).alias("sample_texts"), confidence.alias("confidence"),
        )

    found = F.transform(groups, lambda g: dom.let(F.transform(g["ms"], lambda m: dom.text_of(nodes, m)), lambda texts: measured(g, texts)))
    ranked = F.array_sort(found)
    same = lambda x, y: (x["selector"] == y["selector"]) | F.exists(x["sample_texts"], lambda a: F.exists(y["sample_texts"], lambda b: (a != "") & b.contains(a)))
    step = lambda kept, x: F.when((F.size(kept) >= TOP) | F.exists(kept, lambda y: same(x, y)), kept).otherwise(F.concat(kept, F.array(x)))
    best = dom.let(ranked, lambda every: F.aggregate(every, F.slice(every, 1, 0), step))
    return F.transform(best, lambda x: F.struct(*(x[c].alias(c) for c in ("selector", "count", "avg_text_length", "sample_texts", "confidence"))))


def candidate_sections(pages: DataFrame) -> DataFrame:
    """page_id and sections of the pages that have any."""
    return pages.select("page_id", sections_of(F.col("nodes")).alias("sections")).where(F.size("sections") > 0)
