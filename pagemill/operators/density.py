"""The main text of a page by the density of its blocks, where no element says where it is.

A block is an element of a block's kind without another one inside. It is content if it has words enough and few of them in links, and lies in no area whose
name speaks of comments, navigation, adverts and the like; a short one is content between two that are, and a heading before one that is. Blocks that
follow each other with small gaps are fused, and the group with the most words is the text. One pass over a page's blocks, all within its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

from . import dom

#: Kinds of blocks, and headings among them.
BLOCKS = ["p", "li", "td", "th", "dd", "dt", "blockquote", "pre", "figcaption", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6"]
HEADINGS = ["h2", "h3", "h4", "h5", "h6"]
#: Names of areas that are no content.
JUNK = r"(?i)(^|[\s_-])(ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|menu|nav\w*|newsletter|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)($|[\s_-])"
#: Words that make a block content of itself, the share of them in links that unmakes it, and blocks that may lie between two of one text.
LEAST_WORDS, MOST_LINKED, MOST_GAP = 12, 1 / 3, 2


def _named(n: Column) -> Column:
    return F.concat_ws(" ", F.element_at(n["attrs"], F.lit("class")), F.element_at(n["attrs"], F.lit("id")))


def _words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def blocks(nodes: Column) -> Column:
    """array<struct<tag, text, words, long, fit>> of a page's blocks in order; fit: neither in a junk area nor mostly links; long: content of itself."""
    junk = F.filter(nodes, lambda n: dom.is_element(n) & ~n["tag"].isin("html", "body") & (n["tag"].isin(*dom.NAV, "form", "button") | _named(n).rlike(JUNK)))
    leaves = F.filter(nodes, lambda n: n["tag"].isin(*BLOCKS) & ~F.exists(dom.below(nodes, n), lambda m: m["tag"].isin(*BLOCKS)))
    linked = lambda n: F.aggregate(dom.with_tag(dom.subtree(nodes, n), "a"), F.lit(0), lambda s, a: s + _words(dom.text_of(nodes, a)))

    def of(n: Column, outside: Column) -> Column:
        return let(dom.text_of(nodes, n, " "), lambda text: let(_words(text), lambda words: let((linked(n) <= words * MOST_LINKED) & (words > 0) & ~F.exists(outside, lambda j: dom.inside(n, j) | (n["nid"] == j["nid"])), lambda fit: F.struct(n["tag"].alias("tag"), text.alias("text"), words.alias("words"), fit.alias("fit"), (fit & (words >= LEAST_WORDS) & ~n["tag"].isin("h1", *HEADINGS)).alias("long")))))

    return let(junk, lambda outside: F.transform(leaves, lambda n: of(n, outside)))


def main_text(nodes: Column) -> Column:
    """The main text, a line a block; empty if no block is content."""

    def kept(every: Column) -> Column:
        long = lambda i: F.coalesce(F.get(every, i)["long"], F.lit(False))
        is_content = lambda b, i: b["long"] | b["fit"] & (b["tag"] != "h1") & F.when(b["tag"].isin(*HEADINGS), long(i + 1)).otherwise(long(i - 1) & long(i + 1))
        return F.transform(every, lambda b, i: F.struct(b["text"].alias("text"), b["words"].alias("words"), is_content(b, i).alias("content")))

    nothing = F.struct(F.lit(0).alias("words"), F.lit("").alias("text"))
    begin = F.struct(nothing.alias("best"), nothing.alias("now"), F.lit(0).alias("gap"))
    more = lambda s: F.when(s["now"]["words"] > s["best"]["words"], s["now"]).otherwise(s["best"])

    def step(s: Column, b: Column) -> Column:
        joined = F.struct((s["now"]["words"] + b["words"]).alias("words"), F.when(s["now"]["words"] == 0, b["text"]).otherwise(F.concat(s["now"]["text"], F.lit("\n"), b["text"])).alias("text"))
        alone = F.struct(b["words"].alias("words"), b["text"].alias("text"))
        far = (s["gap"] > MOST_GAP) & (s["now"]["words"] > 0)
        taken = F.when(far, F.struct(more(s).alias("best"), alone.alias("now"), F.lit(0).alias("gap"))).otherwise(F.struct(s["best"].alias("best"), joined.alias("now"), F.lit(0).alias("gap")))
        return F.when(b["content"], taken).otherwise(F.struct(s["best"].alias("best"), s["now"].alias("now"), (s["gap"] + 1).alias("gap")))

    return F.coalesce(let(blocks(nodes), lambda every: F.aggregate(kept(every), begin, step, lambda s: more(s)["text"])), F.lit(""))


def byline(nodes: Column) -> Column:
    """Who wrote a page as it shows: the first link with rel=author, or element whose name speaks of an author; without a leading "by"."""
    own = F.filter(nodes, lambda n: dom.is_element(n) & ((F.element_at(n["attrs"], F.lit("rel")) == "author") | _named(n).rlike(r"(?i)(^|[\s_-])(author|byline)($|[\s_-])")))
    return F.regexp_replace(dom.text_of(nodes, dom.first(own)), r"(?i)^by:?\s+", "")
