"""License scans by canonical digest lookup, in DataFrame functions alone.

A text is put in a canonical form (case, copyright lines, equivalent spellings, punctuation and white space made
alike) and its SHA-256 is hash-joined to the digests of known licences: entire texts match entire texts. The
same lookup is made for each entire line of a text, for notices within documents.

Scale: texts are read and put in form once, and only digests are staged. Lines are exploded, and only those that match
survive the join, before anything is grouped. The known table is joined without a hint: Spark broadcasts it if its size is below its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch
from .licence_texts import ENTIRE, LICENCES

#: Spellings that count as equal, applied in this order to lower-cased text.
EQUIVALENT = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("https:", "http:"),
    ("&", " and "),
    ("\u00a9", "(c)"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("%", " percent "),
]
#: Lines that only say whose copyright it is.
COPYRIGHT_LINE = "(^|\\n)[ \\t]*(copyright|\\(c\\)|all rights reserved)[^\\n]*"
#: Everything that counts as a space, but for line ends: ASCII but letters and digits, and customary quotation marks, dashes, bullets and the no-break space.
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F\u00a0\u2013\u2014\u2018\u2019\u201c\u201d\u2022\u2026]+"


def canonical_lines(text: Column) -> Column:
    """The lines of a text's canonical form, without those that are empty in it; none for null. The form of the whole is these lines with a space between."""
    out = F.lower(text)
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(one), F.lit(other))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "\n"), PUNCTUATION, " ")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(lines: Column) -> Column:
    """The digest of a whole text, of its lines; null if there are none."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_licences(spark: SparkSession, licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, known_digest) of (id, text) pairs; of several ids of one digest the first in order of id. By default those of `licence_texts`.

    The digests are made at once, so that plans hold them and not the texts.
    """
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in (LICENCES + ENTIRE if licences is None else licences)))
    known = digests_of(spark.range(1).select(F.inline(rows))).collect()
    if not known:
        return spark.createDataFrame([], "license_id string, known_digest string")
    out = F.array(*(F.struct(F.lit(r.license_id).alias("license_id"), F.lit(r.known_digest).alias("known_digest")) for r in known))
    return spark.range(1).select(F.inline(out))


def digests_of(licences: DataFrame) -> DataFrame:
    """The same of a table (license_id, text); entries whose canonical form is empty match nothing."""
    rows = licences.select("license_id", digest(canonical_lines(F.col("text"))).alias("known_digest")).where("known_digest is not null and license_id is not null")
    return rows.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def license_scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license_id and line_licenses of `documents` (doc_id, text).

    license_id: the licence that the entire text is, else null. line_licenses: the ids that entire lines are, sorted,
    comma-joined, empty if none. Null and empty texts, and those of copyright lines alone, have a null digest and no
    licence. Rows of equal doc_id share line_licenses; rows with a null doc_id have none. Other columns are not read.
    """
    forms = documents.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    # Texts are put in form once: their digests are staged, and both lookups read them.
    own = forms.select("doc_id", digest(F.col("lines")).alias("canonical_sha256"), F.array_distinct(F.transform("lines", lambda x: F.sha2(x, 256))).alias("line_digests"))
    own = Scratch(documents.sparkSession, "licences").put(own, "digests")
    lines = own.where("doc_id is not null").select("doc_id", F.explode("line_digests").alias("known_digest")).join(known, "known_digest")
    lines = lines.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"))
    whole = own.select("doc_id", "canonical_sha256")
    whole = whole.join(known, whole["canonical_sha256"] == known["known_digest"], "left").drop("known_digest")
    return whole.join(lines, "doc_id", "left").withColumn("line_licenses", F.coalesce("line_licenses", F.lit("")))
