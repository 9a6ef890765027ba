"""URLs as Column expressions: canonical form, resolution, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "yclid", "mc_cid", "mc_eid", "ref", "ref_src", "_hsenc", "_hsmi"]
#: Suffixes of two labels under which names are registered. A fuller list can be given.
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "net.uk", "ltd.uk", "plc.uk", "sch.uk", "nhs.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "co.nz", "net.nz", "org.nz", "govt.nz", "ac.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "go.kr", "co.in", "net.in", "org.in", "gov.in", "ac.in",
    "com.br", "net.br", "org.br", "gov.br", "com.mx", "org.mx", "gob.mx", "com.ar", "com.co", "com.pe", "com.ve", "com.tr", "org.tr", "gov.tr",
    "co.za", "org.za", "gov.za", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.hk", "com.tw", "org.tw", "com.sg", "edu.sg", "gov.sg",
    "com.my", "com.ph", "co.id", "co.th", "com.vn", "com.ua", "co.il", "org.il", "com.eg", "com.sa", "com.pk", "com.bd", "com.ng", "co.ke",
]


def registered_domain(host: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The name under a public suffix; an address or a single label is itself."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return (
        F.when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$") | host.contains(":") | (F.size(labels) < 2), host)
        .when((F.size(labels) >= 3) & last(2).isin(suffixes), last(3))
        .otherwise(last(2))
    )


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column) -> Column:
    """The pairs of a query string without tracking ones, sorted, encoded again; blank values stay."""
    def pair(p: Column) -> Column:
        cut = F.instr(p, "=")
        key, value = F.when(cut > 0, F.substring(p, F.lit(1), cut - 1)).otherwise(p), F.when(cut > 0, F.substring(p, cut + 1, F.length(p))).otherwise("")
        decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
        return F.struct(decoded(key).alias("k"), decoded(value).alias("v"))

    pairs = F.transform(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """struct(original, canonical, domain, host, scheme, error); error is 'invalid_url' and the rest null where it is no http(s) URL with a host."""
    text = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.regexp_extract(text, r"^[^:/?#]+://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(text, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = clean_query(F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1))
    canonical = F.concat(scheme, F.lit("://"), host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    good = scheme.isin("http", "https") & (host != "")
    fields = {"canonical": canonical, "domain": registered_domain(host), "host": host, "scheme": scheme}
    return F.struct(url.alias("original"), *(F.when(good, c).alias(n) for n, c in fields.items()), F.when(~good, "invalid_url").alias("error"))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    parts = F.split(path, "/")
    step = lambda held, s: F.when(s == ".", held).when(s == "..", F.when(F.size(held) > 1, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)).otherwise(F.concat(held, F.array(s)))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    dotted = path.rlike(r"(^|/)\.\.?$")
    out = F.when(dotted & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(~path.rlike(r"(^|/)\.\.?(/|$)"), path).when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def join_url(base: Column, href: Column) -> Column:
    """href resolved against an absolute base."""
    return let(F.trim(href), lambda ref: let(base, lambda b: _joined(b, ref)))


def _joined(base: Column, ref: Column) -> Column:
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    own = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref == "", base)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(ref.startswith("?"), F.concat(root, path, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), rest))
    )


def url_pattern(url: Column) -> Column:
    """The path with segments that look like ids as *."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    wild = lambda s: s.rlike(r"^\d+$") | (F.length(s) > 30) | s.rlike("^[a-f0-9]{8,}$") | (s.contains("-") & s.rlike(r"\d"))
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(wild(s), "*").otherwise(s)), "/")


def glob_regex(pattern: Column) -> Column:
    """A glob (*, ?, [...]) as a regular expression for a whole string; * crosses slashes."""
    out = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\[!", "[^"), r"\*", ".*")
    out = F.regexp_replace(out, r"\?(?![^\[]*\])", ".")  # within brackets it is itself
    return F.concat(F.lit("(?s)^"), out, F.lit("$"))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)
