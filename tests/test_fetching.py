"""From URLs to records under rules, rates and deadlines, with a network and a clock that are made up. Each setting changes an outcome."""

from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill import api
from pagemill.settings import Settings
from pagemill.sources import fetching
from pagemill.sources.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
HTML = '<div class="grid">' + "".join(f'<article class="card"><h2 class="title">Thing {i}</h2><span class="price">${i}.50</span><a class="link" href="/p/{i}">go</a></article>' for i in range(4)) + "</div>"


class FakeClock:
    """Time goes by sleeping and fetching alone."""

    def __init__(self):
        self.time, self.begun = 100.0, []

    def clock(self):
        return fetching.Clock(lambda: self.time, self.sleep)

    def sleep(self, seconds):
        self.time += seconds

    def fetch(self, took=0.0):
        def get(url, seconds):
            self.begun.append((url, round(self.time - 100, 3), seconds))
            self.time += took
            return url, 200, "text/html", HTML.encode(), None

        return get


def served(rows, took=0.0, **settings):
    c = FakeClock()
    out = list(fetching.served(rows, Settings.of(**settings), c.fetch(took), c.clock()))
    return c.begun, {r[0]: r[-1] for r in out}


def test_rates_are_kept_and_domains_take_turns():
    rows = [("a", i, f"https://a/{i}") for i in range(3)] + [("b", 10 + i, f"https://b/{i}") for i in range(2)]
    begun, errors = served(rows)
    assert [(u[8:], t) for u, t, _ in begun] == [("a/0", 0.0), ("b/0", 0.0), ("a/1", 1.0), ("b/1", 1.0), ("a/2", 2.0)] and set(errors.values()) == {None}
    begun, _ = served(rows[:3], rate_per_second=0.5, rate_burst=2)
    assert [t for _, t, _ in begun] == [0.0, 0.0, 2.0]


def test_a_slow_rate_is_given_up():
    begun, errors = served([("a", i, f"https://a/{i}") for i in range(2)], rate_per_second=0.1)
    assert len(begun) == 1 and errors == {0: None, 1: "rate_limited"}


def test_deadlines_bound_jobs_and_steps():
    begun, errors = served([("a", i, f"https://a/{i}") for i in range(4)], took=3.0, job_deadline_seconds=7.0)
    assert [(t, s) for _, t, s in begun] == [(0.0, 7.0), (3.0, 4.0), (6.0, 1.0)] and errors[3] == "deadline"
    assert served([("a", 0, "https://a/")])[0][0][2] == fetching.STEP_SECONDS


def resolve(host):
    if host == "nowhere.com":
        raise OSError("no such host")
    return ["10.0.0.1"] if host.startswith("intern") else ["93.184.216.34"]


def robots(url):
    if "down" in url:
        raise OSError("down")
    return "User-agent: rude\nDisallow: /\nUser-agent: *\nDisallow: /private" if "shop" in url else None


def fetch(url, seconds):
    if "teapot" in url:
        return url, 418, "text/html", b"", None
    if "image" in url:
        return url, 200, "image/png", b"x", None
    return url, 200, "text/html", HTML.encode(), None


URLS = [(0, "https://shop.com/list/1"), (1, "https://shop.com/private/2"), (2, "https://intern.com/"), (3, "https://nowhere.com/"), (4, "ftp://x.com/"), (5, "https://down.com/teapot"), (6, "https://down.com/image"), (7, None)]


def fetched(spark, **settings):
    urls = spark.createDataFrame(URLS, "page_id long, url string")
    out = fetching.fetch_pages(urls, Settings.of(rate_per_second=100.0, **settings), fetch=fetch, resolve=resolve, robots=robots)
    return {r.page_id: r.error for r in out.collect()}


def test_what_may_not_be_fetched_is_a_row(spark):
    assert fetched(spark) == {0: None, 1: "blocked_by_robots", 2: "blocked_target", 3: "dns", 4: "invalid_url", 5: "fetch_error: status 418", 6: "unsupported_content_type", 7: "invalid_url"}


def test_settings_change_what_is_fetched(spark):
    assert fetched(spark, allow_private_targets=True)[2] is None
    assert fetched(spark, user_agent="rude")[0] == "blocked_by_robots"
    late = fetched(spark, job_deadline_seconds=0.0)
    assert late[0] == "deadline" and late[1] == "blocked_by_robots"


def test_rules_that_are_young_are_not_asked_for(spark):
    known = spark.sql("select 'shop.com' host, 'User-agent: *\nDisallow: /list' rules, current_timestamp() - interval 100 seconds fetched_at")
    urls = spark.createDataFrame(URLS[:1], "page_id long, url string")
    for ttl, error in ((3600, "blocked_by_robots"), (60, None)):
        rows = fetching.checked(urls, Settings.of(robots_ttl_seconds=ttl), resolve=resolve, robots=robots, known_robots=known)
        assert rows.first().error == error


def test_urls_to_records(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.migrate()
    engine = api.Engine(spark, store=store, settings=Settings.of(rate_per_second=100.0))
    result = engine.extract_urls(spark.createDataFrame(URLS, "page_id long, url string"), "Extract the title, price and url of all products", fetch=fetch, resolve=resolve, robots=robots)
    assert [(r.page_id, r.title) for r in result.table().orderBy("page_id", "row_idx").collect()] == [(0, f"Thing {i}") for i in range(4)]
    said = {r.page_id: (r.status, r.message) for r in result.jobs.collect()}
    assert said[0] == ("success", None) and said[1] == ("failed", "blocked_by_robots") and len(said) == 8
    assert store.table("jobs").groupBy("status").count().where("status = 'failed'").first()["count"] == 7
    assert store.table("jobs").where("error_code = 'fetch_error'").first().error_message == "fetch_error: status 418"


def test_command_line_takes_urls(spark, capsys):
    from pagemill.cli import main

    assert main(["extract", "https://shop.com/list/1", "Extract the title, price and url of all products", "--format", "csv"], fetch=fetch, resolve=resolve, robots=robots) == 0
    assert "Thing 3,$3.50,https://shop.com/p/3" in capsys.readouterr().out


@pytest.mark.parametrize("n", [0])
def test_no_urls_no_pages(spark, n):
    urls = spark.createDataFrame([], "page_id long, url string")
    assert fetching.fetch_pages(urls, Settings(), fetch=fetch, resolve=resolve, robots=robots).where(F.lit(True)).count() == n
