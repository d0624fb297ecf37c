"""Crawling many hosts at once as one stream, with a state for each host that outlives levels and runs.

Addresses to visit are files that arrive in a folder. They are dealt out by host; a host's state holds what it was asked for, how many pages it gave, how
often in a row it answered 429, and how long to wait between requests. Links of the pages found are new files in the same folder, so each run
of the stream is one level, and a crawl that was ended goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.functions import urls
from quern.operators import crawl

FRONTIER = "url string, depth int, parent_ord bigint, link_ord bigint, cached boolean"
LEVEL = ["url", "depth", "parent_ord", "link_ord"]
ASKED = "host string, url string, depth int, parent_ord bigint, link_ord bigint, place bigint, status int, kind string, body string, trouble string, delay double, waited double"
LOG = f"host string, {FRONTIER.removesuffix(', cached boolean')}, place bigint, delay double, waited double, outcome string, reason string, code int, title string, language string, content string"


class HostState(StatefulProcessor):
    """Asks a host for the addresses that are due, one after the other, and remembers what the next batch must know.

    ``fetch`` is as in ``crawl.crawl``; one with an attribute ``delay`` gets the host's delay before its first request, and what it has become
    afterwards is kept. ``clock`` tells seconds. A host whose ``after``-th 429 in a row came, or that gave ``max_pages`` pages, is not asked again.
    """

    def __init__(self, fetch: Callable[[str], tuple[int, str, str]], allowed: Callable[[str], bool] | None = None, langs: list[str] | None = None, max_pages: int | None = None, after: int = crawl.ABORT_AFTER, clock: Callable[[], float] | None = None):
        self.fetch, self.allowed, self.langs, self.max_pages, self.after, self.clock = fetch, allowed, langs, max_pages, after, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.host = handle.getValueState("host", "delay double, limited int, good bigint, place bigint")
        self.seen = handle.getMapState("seen", "url string", "depth int")
        self.first = getattr(self.fetch, "delay", None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        import time

        clock = self.clock or time.monotonic
        delay, limited, good, place = self.host.get() if self.host.exists() else (self.first, 0, 0, 0)
        if hasattr(self.fetch, "delay"):
            self.fetch.delay = delay
        for frame in rows:
            out = []
            for r in frame.sort_values(LEVEL[1:]).itertuples(index=False):
                if limited >= self.after or (self.max_pages is not None and good >= self.max_pages):
                    break
                if self.seen.containsKey((r.url,)):
                    continue
                self.seen.updateValue((r.url,), (int(r.depth),))
                at, place, began = (key[0], r.url, r.depth, r.parent_ord, r.link_ord, place), place + 1, clock()
                if r.cached:
                    answer = (None, "", None, "cached")
                elif self.allowed and not self.allowed(r.url):
                    answer = (0, "", None, "robots")
                else:
                    try:
                        got = self.fetch(r.url)
                        limited = limited + 1 if got[0] == 429 else 0
                        good += crawl._stored(*got, self.langs)
                        answer = (*got, None)
                    except Exception as e:  # noqa: BLE001  a page that cannot be fetched is an outcome
                        answer = (None, "", None, f"{type(e).__name__}: {e}")
                delay = getattr(self.fetch, "delay", None)
                out.append((*at, *answer, delay, clock() - began))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ASKED.split(", ")])
        self.host.update((delay, limited, good, place))

    def close(self) -> None:
        pass


def _log_of(got: DataFrame, langs: list[str] | None) -> DataFrame:
    keep = ["host", *LEVEL, "place", "delay", "waited"]
    asked = crawl.judged(got.filter("trouble is null or trouble <> 'cached'"), langs, keep)
    absent = [F.lit(None).cast(t).alias(n) for n, t in (("reason", "string"), ("code", "int"), ("title", "string"), ("language", "string"), ("content", "string"), ("body", "string"))]
    return asked.unionByName(got.filter("trouble = 'cached'").select(*keep, F.lit("cached").alias("outcome"), *absent))


def crawl_hosts(
    spark: SparkSession, root: str, fetch: Callable[[str], tuple[int, str, str]], seeds: list[str] | DataFrame = (), history: DataFrame | None = None, max_depth: int = 2, langs: list[str] | None = None, max_pages: int | None = None,
    allowed: Callable[[str], bool] | None = None, max_consecutive_429: int = crawl.ABORT_AFTER, clock: Callable[[], float] | None = None,
) -> DataFrame:
    """Crawl from ``seeds`` (addresses, or rows with ``url``) below the shared folder ``root``; returns the log of all runs on it so far.

    Hosts are asked at the same time, each by one task and one request at a time. ``max_pages`` and ``max_consecutive_429`` count for each host, over all
    levels and runs. Addresses of ``history`` are logged as cached and lead nowhere; an address is visited once, whatever finds it. Called again with the same
    folder it goes on: seeds that were visited are passed over, and links that a broken run had found are visited. A batch that is run again after a failure
    asks again, and its files take the place of the first ones.
    """
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(u,) for u in seeds], "url string")
    known = history.select("url").distinct().withColumn("_h", F.lit(True)) if history is not None else spark.createDataFrame([], "url string, _h boolean")

    def put(rows: DataFrame, name: str) -> None:
        rows.join(known, "url", "left").withColumn("cached", F.coalesce("_h", F.lit(False))).select(*LEVEL, "cached").write.mode("overwrite").parquet(f"{root}/frontier/{name}")

    import uuid

    first = seeds.select("url").withColumn("link_ord", F.monotonically_increasing_id())
    put(first.select("url", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("parent_ord"), "link_ord"), f"seeds-{uuid.uuid4().hex}")
    more = []

    def take(batch: DataFrame, number: int) -> None:
        # written before anything looks at it: what was asked is not asked again, and the state moves once
        batch.write.mode("overwrite").parquet(f"{root}/asked/batch={number}")
        log = _log_of(spark.read.schema(ASKED).parquet(f"{root}/asked/batch={number}"), langs)
        log.drop("body").write.mode("overwrite").parquet(f"{root}/log/batch={number}")
        links = log.filter((F.col("outcome") == "success") & (F.col("depth") < max_depth)).select((F.col("depth") + 1).alias("depth"), F.col("place").alias("parent_ord"), F.posexplode(urls.page_links(F.col("body"), F.col("url"))).alias("link_ord", "url"))
        # of an address that several pages name, the first; what was visited before is known to the host's state
        links = links.groupBy("url").agg(F.min(F.struct("depth", "parent_ord", "link_ord")).alias("at")).select("url", "at.depth", "at.parent_ord", F.col("at.link_ord").cast("bigint").alias("link_ord"))
        put(links, f"batch-{number}")
        more.append(not spark.read.schema(FRONTIER).parquet(f"{root}/frontier/batch-{number}").isEmpty())

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        while True:
            more.clear()
            due = spark.readStream.schema(FRONTIER).option("recursiveFileLookup", True).parquet(f"{root}/frontier")
            due = due.withColumn("host", F.coalesce(urls.authority(F.col("url")), F.lit("")))
            state = HostState(fetch, allowed, langs, max_pages, max_consecutive_429, clock)
            asked = due.groupBy("host").transformWithStateInPandas(statefulProcessor=state, outputStructType=ASKED, outputMode="Append", timeMode="None")
            asked.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            if not any(more):
                break
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{root}/log")
