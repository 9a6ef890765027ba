"""Plans that worked, kept by (domain, goal signature, URL pattern) and used again without planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import glob_regex, path_of

from . import segments

#: How a template's state changes.
ACTIVE_AFTER, BACK_AFTER, REVIEW_AFTER, DROP_AFTER, LEAST_SCORE = 3, 2, 2, 5, 0.80


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def _whole(segments: Column) -> Column:
    return F.array_join(segments, "/")


def shaped(templates: DataFrame) -> DataFrame:
    """`templates` (url_pattern) by the literal segments of their pattern: head (those before the first wildcard, n_head of them), tail (after the last, n_tail) and
    middle (the longest between wildcards, or null). A path that a pattern matches has all three, whatever its wildcards stand for."""
    parts = _segments(F.col("url_pattern"))
    rows = templates.withColumn("_p", parts).withColumn("_w", F.transform("_p", lambda s: s.rlike(r"[*?\[]")))
    first, last = F.array_position("_w", True), F.array_position(F.reverse("_w"), True)  # from 1, and from the end; 0 for none
    n = F.size("_p")
    n_head = F.when(first == 0, n).otherwise(first - 1).cast("int")
    n_tail = F.when(first == 0, 0).otherwise(last - 1).cast("int")
    rows = rows.withColumns({"n_head": n_head, "n_tail": n_tail})
    between = F.slice("_p", F.col("n_head") + 1, n - F.col("n_head") - F.col("n_tail"))
    literal = F.filter(F.transform(between, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), lambda x: ~x["s"].rlike(r"[*?\[]") & (x["s"] != ""))
    rows = rows.withColumns({"head": _whole(F.slice("_p", F.lit(1), F.col("n_head"))), "tail": _whole(F.slice("_p", n - F.col("n_tail") + 1, F.col("n_tail"))), "middle": F.array_max(literal)["s"]})
    return rows.drop("_p", "_w")


def candidates(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """(job_id, path) of requests (job_id, domain, goal_signature, canonical) with the templates whose literal segments their path has; patterns are still to be tried.

    A site has few shapes (how many segments a pattern begins and ends with, and whether it names one between). A request takes one key for each shape of its
    site, or one for each of its segments where the shape has a middle, and meets only the templates of that key.
    """
    site = ["domain", "goal_signature"]
    keyed = shaped(templates).withColumn("has_middle", F.col("middle").isNotNull()).withColumn("middle", F.coalesce("middle", F.lit("")))
    shapes = keyed.select(*site, "n_head", "n_tail", "has_middle").distinct()
    wanted = requests.select("job_id", *site, path_of(F.col("canonical")).alias("path")).withColumn("_s", _segments(F.col("path")))
    n = F.size("_s")
    rows = wanted.join(shapes, site).where(n >= F.col("n_head") + F.col("n_tail"))
    rows = rows.withColumns({"head": _whole(F.slice("_s", F.lit(1), F.col("n_head"))), "tail": _whole(F.slice("_s", F.greatest(n - F.col("n_tail") + 1, F.lit(1)), F.col("n_tail")))})
    rows = rows.withColumn("middle", F.explode(F.when(F.col("has_middle"), F.array_distinct("_s")).otherwise(F.array(F.lit("")))))
    return rows.drop("_s").join(keyed, [*site, "n_head", "n_tail", "has_middle", "head", "tail", "middle"])


def match_templates(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Every request (job_id, domain, goal_signature, canonical) with its best template's id, or null.

    Patterns are tried on the `candidates` alone. Best: active, then candidate, then needs_review, then the higher success_score, then
    the smaller id. The choice is a pre-aggregated minimum, so a domain with very many requests is split by Spark's skew join.
    """
    rank = F.array_position(F.array(*map(F.lit, ["active", "candidate", "needs_review"])), F.col("status"))
    live = templates.where("status <> 'deprecated'").select("domain", "goal_signature", F.col("id").alias("template_id"), "url_pattern", glob_regex(F.col("url_pattern")).alias("regex"), rank.alias("rank"), "success_score")
    found = candidates(requests, live).where("path rlike regex")
    best = found.groupBy("job_id").agg(F.min(F.struct("rank", (-F.col("success_score")).alias("score"), "template_id")).alias("x")).select("job_id", "x.template_id")
    return requests.join(best, "job_id", "left")


def advance(state: Column, success: Column, score: Column) -> Column:
    """A template's state after one more result. A deprecated template stays so."""
    wins = F.when(success, state["successes"] + 1).otherwise(0)
    losses = F.when(success, 0).otherwise(state["failures"] + 1)
    rate = F.when(success, score).otherwise(state["score"])
    status = (
        F.when(state["status"] == "deprecated", "deprecated")
        .when(losses >= DROP_AFTER, "deprecated")
        .when((state["status"] == "candidate") & success & (wins >= ACTIVE_AFTER) & (rate >= LEAST_SCORE), "active")
        .when((state["status"] == "needs_review") & success & (wins >= BACK_AFTER), "active")
        .when((state["status"] == "active") & (losses >= REVIEW_AFTER), "needs_review")
        .otherwise(state["status"])
    )
    return F.struct(status.alias("status"), wins.cast("int").alias("successes"), losses.cast("int").alias("failures"), rate.cast("double").alias("score"))


def lifecycle(results: DataFrame, *, key: str = "template_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The state (status, successes, failures, score) of each template after its results (key, success, score, order columns).

    The rules of `advance` in closed form over streaks, so that a template's history is aggregated in parts: deprecated once
    failures come to DROP_AFTER; a candidate until successes come to ACTIVE_AFTER with a good score; from then on
    needs_review or active by which came last, REVIEW_AFTER failures or BACK_AFTER successes. For streams see streaming.lifecycle.
    """
    rows = streaks(results, key=key, order=order).withColumn("at", F.struct(*order))
    won, lost = F.col("success"), ~F.col("success")
    when = lambda test: F.when(test, F.col("at"))
    found = rows.groupBy(key).agg(
        F.bool_or(lost & (F.col("streak") >= DROP_AFTER)).alias("dropped"), F.min(when(won & (F.col("streak") >= ACTIVE_AFTER) & (F.col("score") >= LEAST_SCORE))).alias("active"),
        F.max(when(lost & (F.col("streak") >= REVIEW_AFTER))).alias("weak"), F.max(when(won & (F.col("streak") >= BACK_AFTER))).alias("well"),
        F.max_by(F.struct("success", "streak"), "at").alias("last"), F.max_by("score", when(won)).alias("score"),
    )
    later = (F.col("weak") > F.col("active")) & (F.col("well").isNull() | (F.col("weak") > F.col("well")))
    status = F.when(F.col("dropped"), "deprecated").when(F.col("active").isNull(), "candidate").when(F.coalesce(later, F.lit(False)), "needs_review").otherwise("active")
    length = F.col("last.streak").cast("int")
    return found.select(key, status.alias("status"), F.when(F.col("last.success"), length).otherwise(0).alias("successes"), F.when(F.col("last.success"), 0).otherwise(length).alias("failures"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))


def advanced(states: DataFrame, results: DataFrame, *, key: str = "template_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The states (key, status, successes, failures, score) after more results of their keys: what `advance` gives from result to result, in closed form.

    The first run of equal results goes on from the state's own counts; everything else is as in `lifecycle`. Keys without results are left out.
    """
    rows = streaks(results, key=key, order=order).withColumn("at", F.struct(*order))
    begun = rows.groupBy(key).agg(F.min_by("success", "at").alias("_first"), F.min(F.when(F.col("success"), F.col("at"))).alias("_won"), F.min(F.when(~F.col("success"), F.col("at"))).alias("_lost"))
    begun = begun.join(states.select(key, *(F.col(c).alias(f"_{c}") for c in ("status", "successes", "failures", "score"))), key)
    rows = rows.join(begun, key)
    turn = F.when(F.col("_first"), F.col("_lost")).otherwise(F.col("_won"))  # the first result of the other kind
    more = F.when(turn.isNull() | (F.col("at") < turn), F.when(F.col("_first"), F.col("_successes")).otherwise(F.col("_failures"))).otherwise(0)
    rows = rows.withColumn("streak", F.col("streak") + more)
    won, lost = F.col("success"), ~F.col("success")
    when = lambda test: F.when(test, F.col("at"))
    begin = ["_status", "_score"]
    found = rows.groupBy(key, *begin).agg(
        F.bool_or(lost & (F.col("streak") >= DROP_AFTER)).alias("dropped"), F.min(when(won & (F.col("streak") >= ACTIVE_AFTER) & (F.col("score") >= LEAST_SCORE))).alias("active"),
        F.max(when(lost & (F.col("streak") >= REVIEW_AFTER))).alias("weak"), F.max(when(won & (F.col("streak") >= BACK_AFTER))).alias("well"),
        F.max_by(F.struct("success", "streak"), "at").alias("last"), F.max_by("score", when(won)).alias("score"),
    )
    candidate = F.col("_status") == "candidate"
    weak = F.when(~candidate | (F.col("weak") > F.col("active")), F.col("weak"))
    status = (
        F.when((F.col("_status") == "deprecated") | F.col("dropped"), "deprecated")
        .when(candidate & F.col("active").isNull(), "candidate")
        .when(weak.isNotNull() & (F.col("well").isNull() | (weak > F.col("well"))), "needs_review")
        .when(F.col("well").isNull() & (F.col("_status") == "needs_review"), "needs_review")
        .otherwise("active")
    )
    length = F.col("last.streak").cast("int")
    return found.select(key, status.alias("status"), F.when(F.col("last.success"), length).otherwise(0).alias("successes"), F.when(F.col("last.success"), 0).otherwise(length).alias("failures"), F.coalesce("score", "_score").cast("double").alias("score"))


def streaks(results: DataFrame, *, key: str = "template_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each result with the length of the run of equal results that it ends; a key with very many results is dealt over many tasks."""
    columns = results.columns
    by = segments.within(key, order)
    rows = segments.segmented(results, key, order)
    rows = rows.withColumn("_change", F.coalesce((F.col("success") != F.lag("success").over(by)).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_change").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("streak", F.row_number().over(Window.partitionBy(segments.SEGMENT, key, "_run").orderBy(*order)))
    # What a segment hands on: the run in which it ends, together with what it got itself if all of it is one run.
    at = F.struct(*order)
    ends = rows.groupBy(segments.SEGMENT, key).agg(F.min_by("success", at).alias("first"), F.max_by(F.struct("success", "streak"), at).alias("last"), (F.max("_run") == 0).alias("one"))
    along = segments.along(key)
    before = lambda c: F.lag(c).over(along)
    joins = F.coalesce(before("last.success") == F.col("first"), F.lit(False))
    ends = ends.withColumns({"_more": F.when(joins, before("last.streak")).otherwise(0), "_new": (~joins | ~F.coalesce(before("one"), F.lit(False))).cast("int")})
    ends = ends.withColumn("_chain", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(key, "_chain").orderBy(segments.SEGMENT).rowsBetween(Window.unboundedPreceding, 0)
    carries = ends.withColumn("_carry", F.sum("_more").over(chain)).where("_carry > 0").select(segments.SEGMENT, key, "_carry")
    out = segments.carried(rows, key, carries)
    return out.select(*columns, (F.col("streak") + F.when(F.col("_run") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0)).cast("int").alias("streak"))


def upsert_templates(templates: DataFrame, new: DataFrame) -> DataFrame:
    """Templates with new ones added; one for each (domain, goal_signature, url_pattern), the newest."""
    columns = templates.columns
    both = templates.select(*columns).unionByName(new.select(*columns))
    keys = ["domain", "goal_signature", "url_pattern"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("updated_at", "id")).alias("x")).select("x.*")
