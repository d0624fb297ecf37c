"""From a question to its context: listings for the router, its reply, the message, the index, chats, export selection."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import graph
from quern.operators.ranking import places

LISTED, INDEX_CHARS, LINE_CHARS = 5, 2000, 100
WEB_TAIL, CLI_TAIL = 10, 20
CHAT_ID = "^[A-Za-z0-9_-]{1,64}$"


def routing_list(articles: DataFrame, entities: DataFrame, most: int = LISTED) -> DataFrame:
    """(name, entities): every article but meta ones, with its first entities."""
    return articles.filter(~F.col("name").startswith("_")).select("name").join(entities, "name", "left").select("name", F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, most).alias("entities"))


def routed_names(replies: DataFrame, articles: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per known article that a reply names, parted by commas; ``none`` names nothing."""
    r = replies.filter(text.norm(F.col(reply)) != "none").select(*[c for c in replies.columns if c != reply], F.posexplode(F.split(reply, ",")).alias("ord", "name"))
    return r.withColumn("name", text.strip(F.col("name"))).join(articles.select("name").distinct(), "name", "left_semi")


def index_lines(articles: DataFrame) -> DataFrame:
    """(name, first_line) of every article but meta ones."""
    return articles.filter(~F.col("name").startswith("_")).select(F.regexp_replace("name", r"\.md", "").alias("name"), F.left(text.first_line(F.col("content")), F.lit(LINE_CHARS)).alias("first_line"))


def article_domains(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, domains): sorted distinct domains of an article's sources; articles without a known source keep an empty list."""
    s = sources.select("name", F.explode_outer("sources").alias("rel")).join(pages.select("rel", "domain").filter("domain is not null"), "rel", "left")
    return s.groupBy("name").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def message(question: str, contents: list[tuple[str, str]], graph_context: str = "") -> str:
    """The question, the chosen articles in order, the graph block."""
    context = "\n\n---\nVerfügbare Wiki-Artikel für diese Frage:\n\n" + "".join(f"### {n}\n{c}\n\n" for n, c in contents) if contents else ""
    if graph_context:
        context += f"\n\n---\n{graph_context}\n"
    return f"{question}\n\n{context}" if context else question


def routed_reply(question: str, listing: DataFrame, call: Callable[[list[dict]], str], route: str = "", read: int = 80_000) -> str:
    """What a model names of ``listing(name, entities)`` for a question.

    A listing of up to ``read`` characters is one call. A longer one is parted: each part's call names some, and further calls choose among those, so
    no prompt and no process holds the whole; these calls run on executors.
    """
    from quern.operators.reduction import reduced

    line = F.concat(F.lit("- "), "name", F.when(F.size("entities") > 0, F.concat(F.lit("  (Entitäten: "), F.array_join("entities", ", "), F.lit(")"))).otherwise(""))
    lines = listing.select("name", line.alias("text"))
    head = "\n\n".join([*([route] if route else []), question])
    if (lines.agg(F.sum(F.length("text") + 1)).first()[0] or 0) <= read:
        rows = [r["text"] for r in lines.orderBy("name").collect()]
        return call([{"role": "user", "content": head + "\n\n" + "\n".join(rows)}])

    def combine(texts: list[str], last: bool) -> str:
        # of the levels above the first a text is a reply: names, parted by commas
        shown = [t if t.startswith("- ") else "\n".join(f"- {n.strip()}" for n in t.split(",") if n.strip() and n.strip() != "none") for t in texts]
        return call([{"role": "user", "content": head + "\n\n" + "\n".join(t for t in shown if t)}])

    return reduced(lines, combine, "name", each=200, read=read, reply=read // 200) or "none"


def prepared(question: str, articles: DataFrame, nodes: DataFrame, edges: DataFrame, call: Callable[[list[dict]], str], view: Callable[[DataFrame], DataFrame] | None = None, history: list[dict] = (), tail: int = WEB_TAIL, route: str = "") -> tuple[list[str], list[dict]]:
    """(sources, messages): route, walk one hop, gather. ``view`` limits articles, and then the graph to what they mention.

    What reaches the driver is the listing for the router, a handful of chosen articles and at most 40 facts.
    """
    shown = articles.transform(view) if view else articles
    found = graph.article_entities(shown, graph.terms_of(nodes)).cache()
    if view:
        nodes, edges = graph.restrict(found, nodes, edges)
    reply = routed_reply(question, routing_list(shown, found), call, route)
    spark = articles.sparkSession
    chosen = [r["name"] for r in routed_names(spark.createDataFrame([(reply,)], "reply string"), shown).orderBy("ord").collect()]
    selected = spark.createDataFrame([(n,) for n in chosen], "name string")
    chosen += [r["name"] for r in graph.expand(selected, found, nodes, edges).filter("is_extra").collect()] if chosen else []
    facts = [r.asDict() for r in graph.context_facts(selected, found, nodes, edges).orderBy("ord").collect()] if chosen else []
    named = found.join(selected, "name", "left_semi").select(F.posexplode("entities").alias("at", "name"))
    described = nodes.join(named, "name").filter("props['description'] <> ''").groupBy("name").agg(F.min("at").alias("at"), F.first("label").alias("label"), F.first(F.col("props")["description"]).alias("description")).orderBy("at", "name").limit(graph.DESCRIPTIONS)
    block = graph.context_block(facts, [r.asDict() for r in described.collect()] if chosen else [])
    contents = {r["name"]: r["content"] for r in shown.filter(F.col("name").isin(chosen)).collect()} if chosen else {}
    messages = [*list(history)[-tail:], {"role": "user", "content": message(question, [(n, contents[n]) for n in chosen if n in contents], block)}]
    found.unpersist()
    return [n.removesuffix(".md") for n in chosen if not n.startswith("_")], messages


def answer(question: str, articles: DataFrame, nodes: DataFrame, edges: DataFrame, call: Callable[[list[dict]], str], view: Callable[[DataFrame], DataFrame] | None = None, history: list[dict] = (), tail: int = WEB_TAIL, route: str = "") -> dict:
    """``prepared``, and the model's answer to it."""
    sources, messages = prepared(question, articles, nodes, edges, call, view, history, tail, route)
    return {"sources": sources, "answer": call(messages)}


def answer_parts(question: str, articles: DataFrame, nodes: DataFrame, edges: DataFrame, call: Callable[[list[dict]], str], stream: Callable[[list[dict]], Iterator[str]], view: Callable[[DataFrame], DataFrame] | None = None, history: list[dict] = (), tail: int = WEB_TAIL, route: str = "") -> Iterator[tuple[str, dict]]:
    """``answer`` as events while the model writes: (type, data), see ``streaming.answers``."""
    from quern.streaming.answers import events_of

    shown = articles.transform(view) if view else articles
    if shown.filter(~F.col("name").startswith("_")).isEmpty():
        yield from events_of(None, [], None, stream)
        return
    try:
        sources, messages = prepared(question, articles, nodes, edges, call, view, history, tail, route)
    except Exception as e:  # noqa: BLE001
        yield from events_of([], [], f"{type(e).__name__}: {e}", stream)
        return
    yield from events_of(sources, messages, None, stream)


def chat_list(messages: DataFrame) -> DataFrame:
    """(conv_id, n, last_turn): chats with their number of messages."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


def listed_chats(chats: DataFrame, bucket: str | None = None) -> DataFrame:
    """(bucket, id, title, updated, place) of ``chats(bucket, id, title, updated)``: newest first within a bucket, ``place`` from 0; of equal times by id.

    With ``bucket`` only that one; without, all of them, however many chats one holds. Chats without id or title are no chats; without a time they come last.
    """
    good = chats.filter(F.col("id").isNotNull() & F.col("title").isNotNull())
    if bucket is not None:
        good = good.filter(F.col("bucket") == bucket)
    good = good.select(F.coalesce("bucket", F.lit("")).alias("bucket"), "id", "title", F.coalesce("updated", F.lit("")).alias("updated"))
    return places(good, ["bucket"], [F.desc("updated"), "id", "title"], "place").select("bucket", "id", "title", "updated", "place")


def stats_view(pages: DataFrame, articles: DataFrame, sources: DataFrame, allowed: list[str] | None = None, compiled: str = "—") -> DataFrame:
    """One row on what a view shows: raw_count, article_count, domains, articles, lint_hints, compiled.

    ``allowed``: domains that the view lets through, None for all. Then pages of these count, and articles with a source among them (``sources(name, sources)``); ``articles``
    lists them with their visible domains. Hints of the lint report, five at most, are shown to the whole view only, as they tell of all domains. What is gathered
    is names of articles and domains.
    """
    seen = pages if allowed is None else pages.filter(F.col("domain").isin(allowed))
    of = article_domains(sources, pages)
    if allowed is not None:
        of = of.withColumn("domains", F.filter("domains", lambda d: d.isin(allowed))).filter("size(domains) > 0")
    own = articles.filter(~F.col("name").startswith("_")).select("name").join(of, "name", "left" if allowed is None else "inner")
    listed = own.agg(F.count("*").alias("article_count"), F.array_sort(F.collect_list(F.struct("name", F.coalesce("domains", F.array().cast("array<string>")).alias("domains")))).alias("articles"))
    listed = listed.withColumn("domains", F.array_sort(F.array_distinct(F.flatten(F.transform("articles", lambda a: a["domains"])))))
    lines = F.transform(F.split("content", "\n"), text.strip)
    hints = F.slice(F.transform(F.filter(lines, lambda x: x.startswith("- ") & (F.length(x) > 4)), lambda x: F.substring(x, 3, 1 << 20)), 1, 5)
    lint = articles.filter((F.col("name") == "_lint-report.md") & F.lit(allowed is None)).agg(F.max(hints).alias("lint_hints"))
    counts = seen.agg(F.count("*").alias("raw_count"))
    none = F.array().cast("array<string>")
    return counts.crossJoin(listed).crossJoin(lint).select("raw_count", "article_count", "domains", "articles", F.coalesce("lint_hints", none).alias("lint_hints"), F.lit(compiled).alias("compiled"))  # three tables of one row


def upsert_chats(chats: DataFrame, new: DataFrame) -> DataFrame:
    """Chats by id with new ones put in place of old ones; ids that are no file names are refused."""
    good = new.filter(F.col("id").rlike(CHAT_ID))
    return chats.join(good.select("bucket", "id"), ["bucket", "id"], "left_anti").unionByName(good)


def delete_chat(chats: DataFrame, bucket: str, chat_id: str) -> DataFrame:
    return chats.filter(~((F.col("bucket") == bucket) & (F.col("id") == chat_id)))


def exported(files: DataFrame, chats: bool = True) -> DataFrame:
    """Files of an export: no temporary and desktop files, chats on request."""
    name = F.element_at(F.split("rel", "/"), -1)
    keep = ~name.endswith(".tmp") & (name != ".DS_Store")
    return files.filter(keep if chats else keep & ~F.col("rel").startswith("chats/"))


def corpus_stats(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: raw pages, articles, domains, languages."""
    p = pages.agg(F.count("*").alias("raw_count"), F.countDistinct("domain").alias("domains"), F.countDistinct("language").alias("languages"))
    return p.crossJoin(articles.filter(~F.col("name").startswith("_")).agg(F.count("*").alias("article_count")))  # one row by one row


def sources_json(sources: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(sources), lambda s: F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)), ", "), F.lit("]"))


def ensured_metadata(content: str, title: str, sources: list[str], today: str) -> str:
    """An article whose block has the program's own sources and date; a fenced block becomes a plain one, a missing one is made."""
    import re

    t = content.lstrip()
    fence = re.match(r"```(?:yaml|markdown|md)?\s*\n", t)
    if fence and (fence[0].startswith("```yaml") or t[fence.end() :].lstrip().startswith("---")):
        t = t[fence.end() :].lstrip("\n")
        if not t.startswith("---"):
            t = "---\n" + t
        end = re.search(r"\n(---|```)\s*(?:\n|$)", t[3:])
        if end:
            head, rest = t[: 3 + end.start()], t[3 + end.end() :]
            rest = re.sub(r"^\s*```\s*\n", "", rest)
            t = f"{head}\n---\n{rest}"
            if end[1] == "---" and t.rstrip().endswith("```") and t.count("```") % 2:
                t = t.rstrip()[:-3].rstrip() + "\n"
    m = re.match(r"---\s*\n(.*?)\n---\s*\n?", t, re.S)
    lines = m[1].split("\n") if m else [f"title: {json.dumps(title, ensure_ascii=False)}"]
    body = t[m.end() :] if m else t

    def put(name: str, value: str):
        kept, inside = [], False
        for line in lines:
            if re.match(rf"{name}\s*:", line):
                inside = True
                continue
            if inside and re.match(r"[ \t]+-", line):
                continue
            inside = False
            kept.append(line)
        lines[:] = [*kept, f"{name}: {value}"]

    put("sources", json.dumps(sorted(sources), ensure_ascii=False))
    put("compiled", json.dumps(today))
    return "---\n" + "\n".join(lines) + "\n---\n\n" + body.lstrip("\n")
