"""Templates by the segments of their patterns: the same choice as trying all, and few of them tried."""

from __future__ import annotations

import fnmatch
import random

from pyspark.sql import functions as F

from pagemill.operators import templates

SCHEMA = "id string, domain string, goal_signature string, url_pattern string, status string, success_score double"


def test_the_same_choice_as_trying_all(spark):
    rng = random.Random(11)
    words = ["a", "b", "shop", "item", "x1", "9", ""]
    known = []
    for i in range(250):
        parts = [rng.choice([*words, "*", "*", "it*", "?", "[ab]", "x[0-9]"]) for _ in range(rng.randint(1, 5))]
        known.append((f"t{i:03d}", rng.choice(["d.com", "e.com"]), rng.choice(["g", "h"]), "/" + "/".join(parts), rng.choice(["active", "candidate", "needs_review", "deprecated"]), round(rng.random(), 1)))
    known += [("any", "e.com", "g", "*", "needs_review", 0.1), ("slash", "d.com", "g", "/", "active", 0.5)]
    asked = [(i, rng.choice(["d.com", "e.com", "f.com"]), rng.choice(["g", "h"]), "https://x/" + "/".join(rng.choice([*words, "itx", "ab"]) for _ in range(rng.randint(1, 6)))) for i in range(300)]
    rank = {"active": 1, "candidate": 2, "needs_review": 3}
    want = {}
    for i, d, g, url in asked:
        path = url[len("https://x") :]
        fits = [(rank[s], -score, t) for t, td, tg, pattern, s, score in known if (td, tg) == (d, g) and s in rank and fnmatch.fnmatchcase(path, pattern)]
        want[i] = min(fits)[2] if fits else None
    out = templates.match_templates(spark.createDataFrame(asked, "job_id long, domain string, goal_signature string, canonical string"), spark.createDataFrame(known, SCHEMA))
    assert {r.job_id: r.template_id for r in out.collect()} == want
    assert sum(v is not None for v in want.values()) > 60


def test_few_are_tried_on_a_site_of_many(spark):
    kinds = [lambda i: f"/c{i}/*", lambda i: f"/*/item{i}", lambda i: f"/*/m{i}/*", lambda i: f"/exact/{i}"]
    known = spark.range(10_000).select("id", F.lit("d.com").alias("domain"), F.lit("g").alias("goal_signature"), F.element_at(F.array(*(F.concat(F.lit(k(0).split("0")[0]), "id", F.lit(k(0).split("0")[1])) for k in kinds)), (F.col("id") % 4 + 1).cast("int")).alias("url_pattern"))
    urls = [f"https://x/c{4 * i}/z" for i in range(50)] + [f"https://x/q/item{4 * i + 1}" for i in range(50)] + [f"https://x/q/m{4 * i + 2}/y" for i in range(50)] + [f"https://x/exact/{4 * i + 3}" for i in range(50)]
    asked = spark.createDataFrame([(i, "d.com", "g", u) for i, u in enumerate(urls)], "job_id long, domain string, goal_signature string, canonical string")
    tried = templates.candidates(asked, known)
    assert tried.count() <= 2 * len(urls)  # and not 10,000 for each
    assert tried.select("job_id").distinct().count() == len(urls)
