"""Scores of extracted records against an intent, one row per job, from one pre-aggregated pass over the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.normalize import parses_as, present
from pagemill.plans.model import Intent


def record_key(record: Column) -> Column:
    """What two records are the same by: url, else href, else name and price, else everything that is there."""
    get = lambda k: F.element_at(record, F.lit(k))
    has = lambda k: present(get(k))
    whole = F.to_json(F.map_from_entries(F.array_sort(F.filter(F.map_entries(record), lambda e: present(e["value"])))))
    return F.when(has("url"), F.concat(F.lit("u|"), get("url"))).when(has("href"), F.concat(F.lit("h|"), get("href"))).when(has("name") & has("price"), F.concat_ws("|", F.lit("n"), get("name"), get("price"))).otherwise(F.concat(F.lit("r|"), whole))


def count_score(n: Column, containers: Column, expected: str) -> Column:
    if expected == "object":
        return F.when(n == 1, 1.0).when(n > 1, 0.5).otherwise(0.0)
    ratio = n / F.greatest(containers, F.lit(1))
    return F.when(ratio <= 1, ratio).otherwise(F.greatest(F.lit(0.5), 1 - 0.5 * (ratio - 1)))


def validate(jobs: DataFrame, records: DataFrame, intent: Intent, digits: int = 4) -> DataFrame:
    """A report for each row of `jobs` (job_id, containers: how many records the page seems to hold, or null) from `records` (job_id, record).

    Columns: n_records, record_count_score, field_coverage_score, type_validity_score, duplication_score, overall_score,
    duplicate_count, missing (field -> records without it), invalid (field -> values not of its type), is_good_enough,
    needs_repair, repair_hint. Jobs without records get the scores of none. Scores are rounded after the flags are set.
    """
    fields = intent.fields
    value = lambda f: F.element_at("record", F.lit(f.name))
    sums = records.groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_distinct(record_key(F.col("record"))).alias("keys"),
        *(F.count_if(present(value(f))).alias(f"p_{f.name}") for f in fields), *(F.count_if(present(value(f)) & parses_as(value(f), f.type, fuzzy_dates=True)).alias(f"o_{f.name}") for f in fields),
    )
    rows = jobs.join(sums, "job_id", "left").fillna(0, ["n", "keys", *(f"{a}_{f.name}" for a in "po" for f in fields)])
    n, some = F.col("n"), F.col("n") > 0
    least = F.greatest(n, F.lit(1))  # what is divided by: an engine may work out branches that it does not take
    p, o = (lambda f, a=a: F.col(f"{a}_{f.name}") for a in "po")
    required, optional = [f for f in fields if f.required], [f for f in fields if not f.required]

    def coverage(own: list) -> Column:  # noqa: ANN001
        return sum((p(f) / least for f in own), F.lit(0.0)) / len(own) if own else F.lit(1.0)

    shown, right = sum((p(f) for f in fields), F.lit(0)), sum((o(f) for f in fields), F.lit(0))
    rows = rows.withColumns(
        {
            "count_s": F.when(some, count_score(n, F.coalesce("containers", F.greatest(n, F.lit(1))), intent.expected)).otherwise(0.0),
            "cover_s": F.when(some, 0.7 * coverage(required) + 0.3 * coverage(optional)).otherwise(F.lit(0.0 if required else 1.0)),
            "type_s": F.when(some & (shown > 0), right / F.greatest(shown, F.lit(1))).otherwise(1.0),
            "dup_s": F.when(some, 1 - (n - F.col("keys")) / least).otherwise(1.0),
        }
    )
    rows = rows.withColumn("score", 0.20 * F.col("count_s") + 0.45 * F.col("cover_s") + 0.25 * F.col("type_s") + 0.10 * F.col("dup_s"))
    lacks = lambda f, share: some & ((n - p(f)) / least > share)
    half = _any(lacks(f, 0.5) for f in required)
    third = _any(lacks(f, 0.3) for f in required)
    none = F.lit(intent.expected == "array") & ~some
    good = (F.col("score") >= 0.80) & ~half & ~none
    repair = (F.col("score") < 0.60) | ((F.col("score") < 0.80) & third) | half | none
    worst = F.array_max(F.array(*(F.struct((p(f) - o(f)).alias("bad"), F.lit(-i).alias("order"), F.lit(f.name).alias("name")) for i, f in enumerate(fields))))["name"]
    hint = F.when(~some, "no records were found")
    for f in required:
        hint = hint.when(lacks(f, 0.5), f"required field {f.name} is missing in most records")
    hint = hint.when(F.col("dup_s") < 0.7, "many records are duplicates").when(F.col("type_s") < 0.6, F.concat(F.lit("values of field "), worst, F.lit(" are not of its type")))
    pairs = lambda own, count, least: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f.name).alias("k"), count(f).alias("v")) for f in own)), lambda e: e["v"] >= least))
    return rows.select(
        "job_id", n.alias("n_records"), F.bround("count_s", digits).alias("record_count_score"), F.bround("cover_s", digits).alias("field_coverage_score"), F.bround("type_s", digits).alias("type_validity_score"),
        F.bround("dup_s", digits).alias("duplication_score"), F.bround("score", digits).alias("overall_score"), (n - F.col("keys")).alias("duplicate_count"),
        pairs(fields, lambda f: F.when(some, n - p(f)).otherwise(F.lit(0).cast("long")), 1).alias("missing"), pairs(fields, lambda f: p(f) - o(f), 1).alias("invalid"),
        good.alias("is_good_enough"), repair.alias("needs_repair"), hint.alias("repair_hint"),
    )


def _any(tests) -> Column:  # noqa: ANN001
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def response_status(good: Column, n_records: Column, score: Column) -> Column:
    return F.when(good, "success").when((n_records > 0) | (score >= 0.3), "partial_success").otherwise("failed")


def field_coverage(stats: DataFrame) -> DataFrame:
    """Share of a job's records that have a field, of (page_id, field, hits, misses)."""
    return stats.withColumn("coverage", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))
