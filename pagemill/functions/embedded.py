"""Data embedded in HTML: JSON-LD, OpenGraph, Twitter cards, microdata and hydration payloads. Columns over raw HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where pages keep such data.
JSON_LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
NEXT_DATA = r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
OPEN_GRAPH = r"(?i)<meta[^>]+property=\"(og:[^\"]+)\"[^>]+content=\"([^\"]*)\""
TWITTER = r"(?i)<meta[^>]+name=\"(twitter:[^\"]+)\"[^>]+content=\"([^\"]*)\""
MICRODATA = r"(?i)itemtype=\"https?://schema\.org/([A-Za-z]+)\""
PAYLOADS, KEYS, PREVIEW = 5, 30, 2048


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _map(html: Column, pattern: str) -> Column:
    """The first KEYS distinct names; of a name's values the last."""
    names, values = _all(html, pattern, 1), _all(html, pattern, 2)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    kept = F.slice(F.array_distinct(names), 1, KEYS)
    return F.map_from_arrays(kept, F.transform(kept, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def payloads(html: Column) -> Column:
    """JSON texts of the first PAYLOADS JSON-LD blocks that parse and, if there is room, of the hydration payload: struct(source, json)."""
    good = lambda array: F.filter(F.transform(array, lambda t: F.trim(t)), lambda t: F.try_parse_json(t).isNotNull())
    linked = F.transform(F.slice(good(_all(html, JSON_LD)), 1, PAYLOADS), lambda t: F.struct(F.lit("json_ld").alias("source"), t.alias("json")))
    hydration = F.filter(good(_all(html, NEXT_DATA)), lambda t: t.startswith("{"))
    return F.slice(F.concat(linked, F.transform(hydration, lambda t: F.struct(F.lit("next_data").alias("source"), t.alias("json")))), 1, PAYLOADS)


def items_of(json: Column) -> Column:
    """The objects of a payload: those of a list or of @graph, else itself."""
    listed = F.from_json(json, "array<string>")
    graph = F.from_json(F.get_json_object(json, "$['@graph']"), "array<string>")
    return F.when(json.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).when(graph.isNotNull(), graph).otherwise(F.array(json))


def types_of(json: Column) -> Column:
    """@type of each item, a string or a list of them."""
    def own(item: Column) -> Column:
        t = F.get_json_object(item, "$['@type']")
        return F.when(t.isNull(), F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(t))

    return F.flatten(F.transform(items_of(json), own))


def embedded(html: Column) -> Column:
    """struct(json_ld_types, open_graph, twitter, microdata_types, next_data_present, nuxt_present, initial_state_present, payloads)."""
    own = payloads(html)
    linked = F.filter(own, lambda p: p["source"] == "json_ld")
    types = F.array_sort(F.array_distinct(F.flatten(F.transform(linked, lambda p: types_of(p["json"])))))
    return F.struct(
        types.alias("json_ld_types"), _map(html, OPEN_GRAPH).alias("open_graph"), _map(html, TWITTER).alias("twitter"),
        F.array_sort(F.array_distinct(_all(html, MICRODATA))).alias("microdata_types"), html.rlike(NEXT_DATA).alias("next_data_present"),
        html.rlike(r"window\.__NUXT__").alias("nuxt_present"), html.rlike(r"window\.__INITIAL_STATE__").alias("initial_state_present"), own.alias("payloads"),
    )


def preview(json: Column) -> Column:
    """What a planner is shown of a payload; execution reads it whole."""
    short = F.to_json(F.struct(F.lit(True).alias("truncated"), F.substring(json, 1, PREVIEW).alias("preview")))
    return F.when(F.length(json) > PREVIEW, short).otherwise(json)
