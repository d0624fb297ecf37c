"""Crawling as sets: frontiers, plans, outcomes, and whether a host blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import html, text, urls
from quern.operators.ranking import running_sum
from quern.state import cut

#: When a host counts as blocking.
OK_RATIO, LEAST_COUNT, MAJORITY = 0.05, 3, 0.5
ABORT_AFTER = 5
SHIELD_CODES = (401, 403, 407)
LEAST_CHARS = 50


def block_label(code: Column) -> Column:
    return (
        F.when(code == 429, F.lit("Rate-Limit (HTTP 429)"))
        .when(code == 503, F.lit("Dienst nicht verfügbar / Bot-Schutz (HTTP 503)"))
        .when(code.isin(*SHIELD_CODES), F.concat(F.lit("WAF/Bot-Schutz (HTTP "), code.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("HTTP "), code.cast("string")))
    )


def http_code(reason: Column) -> Column:
    """The first status code in a failure's reason; null without one."""
    return F.regexp_extract(reason, r"HTTP (\d+)", 1).try_cast("int") if hasattr(Column, "try_cast") else F.expr("try_cast(regexp_extract(reason, 'HTTP ([0-9]+)', 1) as int)")


def block_status(log: DataFrame) -> DataFrame:
    """Per domain of ``log(domain, seq, outcome, code)``: ok, failed, blocked, reason, top_status.

    Blocked: hardly any success, and one code makes up at least half of the failures, three at least. Of equally frequent codes the one
    that came first counts; 200 is no failure code.
    """
    totals = log.groupBy("domain").agg(F.count_if(F.col("outcome") == "success").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    codes = log.filter("outcome = 'failed' and code is not null and code <> 200").groupBy("domain", "code").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    top = codes.groupBy("domain").agg(F.max(F.struct("n", F.struct(*_negated(codes, "first")).alias("o"), "code")).alias("t")).select("domain", F.col("t.code").alias("code"), F.col("t.n").alias("n"))
    r = totals.join(top, "domain", "left")
    bare = (F.col("ok") == 0) | (F.col("ok") / (F.col("ok") + F.col("failed")) < OK_RATIO)
    blocked = F.coalesce(bare & (F.col("n") >= F.greatest(F.lit(LEAST_COUNT).cast("double"), MAJORITY * F.col("failed"))), F.lit(False))
    reason = F.concat(block_label(F.col("code")), F.lit(" — "), F.col("n").cast("string"), F.lit("/"), F.col("failed").cast("string"), F.lit(" URLs geblockt"))
    return r.select("domain", "ok", "failed", blocked.alias("blocked"), F.when(blocked, reason).alias("reason"), F.when(blocked, F.col("code")).alias("top_status"))


def _negated(df: DataFrame, name: str) -> list[Column]:
    """Columns whose maximum is the minimum of ``name``, a number or a struct of numbers."""
    kind = df.schema[name].dataType
    parts = [F.col(f"{name}.{f.name}") for f in kind.fields] if hasattr(kind, "fields") else [F.col(name)]
    return [(-p.cast("bigint")).alias(f"n{i}") for i, p in enumerate(parts)]


def _coarse(log: DataFrame) -> Column:
    """An hour of a sequence that begins with microseconds, or a thousand of a plain number."""
    kind = log.schema["seq"].dataType
    return F.floor(F.col(f"seq.{kind.fields[0].name}") / 3_600_000_000) if hasattr(kind, "fields") else F.floor(F.col("seq") / 1000)


def abort_points(log: DataFrame, after: int = ABORT_AFTER) -> DataFrame:
    """(domain, abort_seq): where the fifth 429 answer in a row comes; domains without are left out.

    Rows without an answer (network errors) neither lengthen nor end a run. ``seq`` is a number or a struct that begins with
    microseconds.
    """
    answers = log.filter("code is not null or outcome = 'success'").withColumn("_is", F.coalesce(F.col("code") == 429, F.lit(False)))
    runs = running_sum(answers, ["domain"], "seq", _coarse(log), F.when(F.col("_is"), 0).otherwise(1), "_run_no").filter("_is")
    placed = running_sum(runs, ["domain", "_run_no"], "seq", _coarse(log), F.lit(1), "_n")
    return placed.filter(F.col("_n") == after).groupBy("domain").agg(F.min("seq").alias("abort_seq"))


def outcomes(log: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Rows per domain and outcome, of a crawl that stops after ``max_pages`` successes of a domain."""
    if max_pages is not None:
        good = F.when(F.col("outcome") == "success", 1).otherwise(0)
        log = running_sum(log, ["domain"], "seq", _coarse(log), good, "_done").filter(F.col("_done") - good < max_pages)
    return log.groupBy("domain", "outcome").agg(F.count("*").alias("n"))


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome").agg(F.count("*").alias("n"))


def outcome_of(status: Column, content_type: Column, markdown: Column) -> Column:
    """failed (other than 200), skipped (no HTML, or hardly any text), success."""
    return F.when(status != 200, "failed").when(~F.coalesce(content_type, F.lit("")).contains("text/html"), "skipped").when(F.length(text.strip(F.coalesce(markdown, F.lit("")))) < LEAST_CHARS, "skipped").otherwise("success")


def next_frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Linked addresses not visited yet, each once, at the least place it was seen (``links(url, depth, parent_ord, link_ord)``)."""
    return links.groupBy("url").agg(F.min(F.struct("depth", "parent_ord", "link_ord")).alias("at")).join(visited.select("url"), "url", "left_anti").select("url", "at.*")


def collect_plan(wanted: DataFrame, history: DataFrame) -> DataFrame:
    """(url, ord, outcome): each address once, ``cached`` if the history has it, else ``fetch``."""
    once = wanted.groupBy("url").agg(F.min("ord").alias("ord"))
    return once.join(history.select("url").distinct().withColumn("_c", F.lit(True)), "url", "left").select("url", "ord", F.when(F.col("_c"), "cached").otherwise("fetch").alias("outcome"))


def _stored(status: int, kind: str, body: str, langs: list[str] | None) -> bool:
    """Whether a crawl keeps an answer: what ``outcome_of`` and the filter of languages call a success, for one page."""
    if status != 200 or "text/html" not in kind:
        return False
    content = body if "text/markdown" in kind else html.to_markdown(body)
    if len((content or "").strip()) < LEAST_CHARS:
        return False
    found = html.page_language(body, content) if langs else None
    return not langs or found is None or found in [x.lower() for x in langs]


def _fetched(due: DataFrame, fetch: Callable[[str], tuple[int, str, str]], allowed: Callable[[str], bool] | None, langs: list[str] | None, left: int | None = None, limited: int = 0, after: int | None = None, delay: float | None = None) -> DataFrame:
    """Pages fetched on executors with what became of them; ``due(url, depth, parent_ord, link_ord)``, in the order of its partitions.

    A task ends early with its ``left``-th success, or with the ``after``-th 429 answer in a row (``limited`` of them came before): later rows
    are not asked for and not returned. ``place`` numbers a task's rows. ``delay``: what a fetcher that has one waits at first; its delay after each
    answer is returned with the row.
    """
    schema = "url string, depth int, parent_ord bigint, link_ord bigint"

    def run(frames):
        import pandas as pd

        in_row, good, place = limited, 0, 0
        if delay is not None and hasattr(fetch, "delay"):
            fetch.delay = delay
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if (left is not None and good >= left) or (after is not None and in_row >= after):
                    break
                at, place = (r.url, r.depth, r.parent_ord, r.link_ord, place), place + 1
                waits = lambda: getattr(fetch, "delay", None)
                if allowed and not allowed(r.url):
                    rows.append((*at, 0, "", None, "robots", waits()))
                    continue
                try:
                    answer = fetch(r.url)
                    in_row = in_row + 1 if answer[0] == 429 else 0
                    good += left is not None and _stored(*answer, langs)
                    rows.append((*at, *answer, None, waits()))
                except Exception as e:  # noqa: BLE001  a page that cannot be fetched is an outcome
                    rows.append((*at, None, "", None, f"{type(e).__name__}: {e}", waits()))
            yield pd.DataFrame(rows, columns=["url", "depth", "parent_ord", "link_ord", "place", "status", "kind", "body", "trouble", "delay"])

    got = due.select("url", "depth", "parent_ord", "link_ord").mapInPandas(run, schema + ", place bigint, status int, kind string, body string, trouble string, delay double")
    # written at once: what was fetched is not fetched again
    return judged(cut(got, "fetched"), langs, ["url", "depth", "parent_ord", "link_ord", "place", "delay"])


def judged(got: DataFrame, langs: list[str] | None, keep: list[str]) -> DataFrame:
    """What became of ``got(url, status, kind, body, trouble)``: the columns ``keep``, outcome, reason, code, title, language, content, body.

    ``trouble`` is ``robots``, an error of the fetch, or null.
    """
    got = got.withColumn("content", F.when(F.col("kind").contains("text/markdown"), F.col("body")).otherwise(html.markdown("body")))
    got = got.withColumn("language", F.coalesce(html.declared_language(F.col("body")), html.guessed_language("content")))
    outcome = F.when(F.col("trouble") == "robots", "skipped").when(F.col("trouble").isNotNull(), "failed").otherwise(outcome_of(F.col("status"), F.col("kind"), F.col("content")))
    if langs:
        outcome = F.when((outcome == "success") & F.col("language").isNotNull() & ~F.col("language").isin([x.lower() for x in langs]), "skipped").otherwise(outcome)
    reason = F.when(F.col("trouble").isNotNull(), F.col("trouble")).when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return got.select(*keep, outcome.alias("outcome"), reason.alias("reason"), F.when(F.col("status") > 0, F.col("status")).alias("code"), html.title(F.col("body"), F.col("url")).alias("title"), "language", "content", "body")


def _limited_at_end(done: DataFrame, before: int) -> int:
    """How many 429 answers in a row a level ends with; ``before``: how many the levels before it ended with."""
    answers = done.filter("code is not null")
    other = answers.filter("code <> 429").agg(F.max("place").alias("p")).first()["p"]
    return answers.filter(F.col("place") > F.lit(-1 if other is None else other)).count() + (before if other is None else 0)


def crawl(start: str, fetch: Callable[[str], tuple[int, str, str]], spark, history: DataFrame | None = None, max_depth: int = 2, langs: list[str] | None = None, max_pages: int | None = None, allowed: Callable[[str], bool] | None = None, seeds: list[str] = (), max_consecutive_429: int = ABORT_AFTER) -> DataFrame:
    """Breadth-first crawl of one host, a level at a time; returns a log of every address that was reached.

    ``fetch(url) -> (status, content type, body)`` runs on an executor. Log: url, depth, parent_ord, link_ord, place, outcome, reason, code, title, language,
    content. Addresses of the history are not fetched again and lead nowhere. One host is asked by one task, one address after the other in the order they
    were found: a host is never asked by two at once. The crawl ends with success number ``max_pages``, or with the
    ``max_consecutive_429``-th 429 answer in a row, counted across levels. The loop runs ``max_depth + 1`` times at most, whatever the number of pages.
    """
    schema = "url string, depth int, parent_ord bigint, link_ord bigint"
    frontier = spark.createDataFrame([(u, 0, 0, i) for i, u in enumerate(dict.fromkeys([start, *seeds]))], schema)
    known = history.select("url").distinct() if history is not None else spark.createDataFrame([], "url string")
    visited = frontier.select("url").limit(0)
    out, pages, limited, delay = None, 0, 0, None
    for depth in range(max_depth + 1):
        level = cut(frontier.join(known.withColumn("_h", F.lit(True)), "url", "left"), "frontier")
        if level.isEmpty():
            break
        due = level.filter("_h is null").repartition(1).sortWithinPartitions("parent_ord", "link_ord")
        done = _fetched(due, fetch, allowed, langs, None if max_pages is None else max_pages - pages, limited, max_consecutive_429, delay)
        absent = (("place", "bigint"), ("delay", "double"), ("reason", "string"), ("code", "int"), ("title", "string"), ("language", "string"), ("content", "string"), ("body", "string"))
        cached = level.filter("_h").select("url", "depth", "parent_ord", "link_ord", F.lit("cached").alias("outcome"), *[F.lit(None).cast(t).alias(n) for n, t in absent])
        done = cut(done.unionByName(cached), "done")
        shown = done.drop("body", "delay")
        out = shown if out is None else out.unionByName(shown)
        visited = visited.union(level.select("url"))
        pages += done.filter("outcome = 'success'").count()
        limited = _limited_at_end(done, limited)
        last = done.agg(F.max_by("delay", "place")).first()[0]
        delay = delay if last is None else last  # what limits have made of it stays for the next level
        if limited >= max_consecutive_429 or (max_pages is not None and pages >= max_pages):
            break
        links = done.filter("outcome = 'success'").select(F.lit(depth + 1).alias("depth"), F.col("place").alias("parent_ord"), F.posexplode(urls.page_links(F.col("body"), F.col("url"))).alias("link_ord", "url"))
        frontier = next_frontier(links.withColumn("link_ord", F.col("link_ord").cast("bigint")), visited)
    return out


def collect(wanted: DataFrame, fetch: Callable[[str], tuple[int, str, str]], history: DataFrame | None = None, langs: list[str] | None = None, max_pages: int | None = None) -> DataFrame:
    """Fetch a list of addresses ``wanted(url, ord)``, each once, without following links; a log as of ``crawl``.

    Cached addresses are told apart by a join. The rest is fetched host by host, each by one task in the order of the list, hosts in parallel. With
    ``max_pages`` one task goes through the whole list and ends with that success: the limit is over all hosts and by order.
    """
    spark = wanted.sparkSession
    known = history if history is not None else spark.createDataFrame([], "url string")
    plan = cut(collect_plan(wanted, known), "plan")
    due = plan.filter("outcome = 'fetch'").select("url", F.lit(0).alias("depth"), F.col("ord").cast("bigint").alias("parent_ord"), F.lit(0).cast("bigint").alias("link_ord"))
    host = F.coalesce(urls.authority(F.col("url")), F.lit(""))
    dealt = due.repartition(host).sortWithinPartitions(host, "parent_ord") if max_pages is None else due.repartition(1).sortWithinPartitions("parent_ord")
    fetched = _fetched(dealt, fetch, None, langs, max_pages)
    cached = plan.filter("outcome = 'cached'").select("url", F.lit(0).alias("depth"), F.col("ord").cast("bigint").alias("parent_ord"), F.lit(0).cast("bigint").alias("link_ord"), F.lit("cached").alias("outcome"))
    return fetched.drop("body", "delay").unionByName(cached, allowMissingColumns=True)
