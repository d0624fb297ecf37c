"""A crawl of many hosts as a stream: what a host's state keeps over levels and runs, by a clock that only the fetcher moves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.sources.fetch import Fetcher
from quern.streaming.crawl_state import crawl_hosts

FILLER = "words of a page that is long enough to be kept as one " * 2


class Clock:
    now = 0.0

    def __call__(self):
        return Clock.now

    @staticmethod
    def sleep(seconds):
        Clock.now += seconds


class Site:
    """Pages /0, /1, ... of a host; each links to the next two. ``limited``: addresses that answer 429."""

    def __init__(self, limited=(), n=9):
        self.limited, self.n = set(limited), n

    def __call__(self, url):
        if url in self.limited:
            return 429, {}, b""
        k = int(url.rsplit("/", 1)[1] or 0)
        if k >= self.n:
            return 404, {}, b""
        links = "".join(f'<a href="/{k + i}">x</a>' for i in (1, 2))
        return 200, {"content-type": "text/html"}, f"<html lang='en'><title>{k}</title><body><p>{FILLER}</p>{links}</body></html>".encode()


def rows(log, host):
    return [r.asDict() for r in log.filter(F.col("host") == host).orderBy("place").collect()]


def test_a_doubled_delay_outlives_its_level(spark, tmp_path):
    fetch = Fetcher(Site(limited=["http://a.org/1"]), delay=0.5, sleep=Clock.sleep)
    log = crawl_hosts(spark, str(tmp_path), fetch, ["http://a.org/0", "http://b.org/0"], max_depth=2, clock=Clock()).cache()
    a, b = rows(log, "a.org"), rows(log, "b.org")
    assert [(r["url"][-1], r["depth"], r["outcome"]) for r in a] == [("0", 0, "success"), ("1", 1, "failed"), ("2", 1, "success"), ("3", 2, "success"), ("4", 2, "success")]
    # three tries double the delay twice; it stays for the rest of the level and for the next one
    assert [r["delay"] for r in a] == [0.5, 2.0, 2.0, 2.0, 2.0] and [r["waited"] for r in a[2:]] == [2.0, 2.0, 2.0]
    assert {r["delay"] for r in b} == {0.5} and {r["outcome"] for r in b} == {"success"}  # another host is not slowed down


def test_limits_in_a_row_count_over_levels_and_runs(spark, tmp_path):
    limited = [f"http://a.org/{k}" for k in (1, 2)] + ["http://a.org/7", "http://a.org/8"]
    fetch = Fetcher(Site(limited=limited), delay=0.0, sleep=Clock.sleep)
    log = crawl_hosts(spark, str(tmp_path), fetch, ["http://a.org/0", "http://b.org/5"], max_depth=1, max_consecutive_429=3)
    assert [r["code"] for r in rows(log, "a.org")] == [200, 429, 429]
    log = crawl_hosts(spark, str(tmp_path), fetch, ["http://a.org/7", "http://a.org/8", "http://b.org/5"], max_depth=0, max_consecutive_429=3)
    assert [r["url"][-1] for r in rows(log, "a.org")] == ["0", "1", "2", "7"]  # the third in a row ends the host
    assert len(rows(log, "b.org")) == 3  # a seed that was visited is passed over


@pytest.mark.parametrize("most", [1, 3])
def test_pages_are_counted_for_each_host(spark, tmp_path, most):
    hosts = [f"http://h{k}.org/0" for k in range(6)]
    log = crawl_hosts(spark, str(tmp_path), Fetcher(Site(), delay=0.0, sleep=Clock.sleep), hosts, max_depth=5, max_pages=most)
    assert {(r["host"], r["n"]) for r in log.groupBy("host").agg(F.count_if(F.col("outcome") == "success").alias("n")).collect()} == {(f"h{k}.org", most) for k in range(6)}


def test_history_robots_and_errors(spark, tmp_path):
    def fetch(url):
        if url.endswith("/2"):
            raise OSError("no route")
        return Fetcher(Site(), delay=0.0, sleep=Clock.sleep)(url)

    history = spark.createDataFrame([("http://a.org/1",)], "url string")
    log = crawl_hosts(spark, str(tmp_path), fetch, ["http://a.org/0", "http://a.org/9"], history, 2, allowed=lambda u: not u.endswith("/9"))
    assert {(r["url"][-1], r["outcome"], r["reason"]) for r in log.collect()} == {("0", "success", None), ("9", "skipped", "robots"), ("1", "cached", None), ("2", "failed", "OSError: no route")}


def test_a_crawl_of_nothing(spark, tmp_path):
    assert crawl_hosts(spark, str(tmp_path), Fetcher(Site()), []).count() == 0
