"""Command line.

    python -m quern.cli crawl https://host --out data/pages [--depth 2] [--max-pages N] [--lang de,en] [--delay 0.5] [--sitemap URL] [--no-sitemap]
    python -m quern.cli collect bookmarks.html --out data/pages [--max-pages N] [--lang de,en]
    python -m quern.cli documents FOLDER --label NAME --data data --reader module:open [--password P] [--max-pages N] [--text-threshold 200] [--force-vision] [--fresh]
    python -m quern.cli migrate-lang --raw data/raw [--dry-run]
    python -m quern.cli compile --raw data/raw --state data/state [--only-domains a,b] [--lang de,en] [--wiki-dir data/wiki] [--lint] [--model-index] [--jobs 4] [--canonicalize] [--graph-only | --canonicalize-only] [--graph-dir data/graph]
    python -m quern.cli ask "question" --state data/state [--events]
    python -m quern.cli suggestions --state data/state
    python -m quern.cli queries
    python -m quern.cli run NAME --sf-dir DIR --out DIR
    python -m quern.cli export --data data --out export.zip [--no-chats]

A model provider is a callable named ``module:attribute``; the default answers deterministically without a model.
"""

from __future__ import annotations

import argparse
import importlib
import json
from datetime import date


def provider(name: str | None):
    from quern.provider import EchoModel, retrying

    if not name:
        return EchoModel()
    module, _, attribute = name.partition(":")
    return retrying(getattr(importlib.import_module(module), attribute))


def _split(value: str | None) -> list[str] | None:
    return [v.strip() for v in value.split(",") if v.strip()] if value else None


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quern")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("crawl", "collect"):
        p = sub.add_parser(name)
        p.add_argument("start")
        p.add_argument("--out", required=True)
        p.add_argument("--history")
        p.add_argument("--max-pages", type=int)
        p.add_argument("--lang")
        p.add_argument("--delay", type=float, default=0.5)
        if name == "crawl":
            p.add_argument("--depth", type=int, default=2)
            p.add_argument("--sitemap")
            p.add_argument("--sitemap-max", type=int, default=5000)
            p.add_argument("--no-sitemap", action="store_true")
    models = argparse.ArgumentParser(add_help=False)
    models.add_argument("--state", required=True)
    models.add_argument("--provider")
    models.add_argument("--model", default="")
    models.add_argument("--language", default="de")
    c = sub.add_parser("compile", parents=[models])
    c.add_argument("--raw", required=True)
    c.add_argument("--only-domains")
    c.add_argument("--lang")
    c.add_argument("--wiki-dir")
    c.add_argument("--jobs", type=int, default=4)
    c.add_argument("--lint", action="store_true")
    c.add_argument("--canonicalize", action="store_true")
    c.add_argument("--graph-only", action="store_true")
    c.add_argument("--canonicalize-only", action="store_true")
    c.add_argument("--graph-dir")
    c.add_argument("--model-index", action="store_true")
    a = sub.add_parser("ask", parents=[models])
    a.add_argument("question")
    a.add_argument("--events", action="store_true")
    sub.add_parser("suggestions", parents=[models])
    d = sub.add_parser("documents")
    d.add_argument("path")
    for name in ("--label", "--data", "--reader"):
        d.add_argument(name, required=True)
    for name in ("--password", "--vision"):
        d.add_argument(name)
    d.add_argument("--max-pages", type=int)
    d.add_argument("--text-threshold", type=int, default=200)
    d.add_argument("--jobs", type=int, default=4)
    d.add_argument("--force-vision", action="store_true")
    d.add_argument("--fresh", action="store_true")
    m = sub.add_parser("migrate-lang")
    m.add_argument("--raw", required=True)
    m.add_argument("--dry-run", action="store_true")
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("--sf-dir", required=True)
    r.add_argument("--out", required=True)
    e = sub.add_parser("export")
    e.add_argument("--data", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--no-chats", action="store_true")
    sub.add_parser("queries")
    return parser


def _pages(spark, a) -> None:
    """A crawl or a collection as a table of its log, pages with their metadata block included."""
    from pyspark.sql import functions as F

    from quern.functions import text, urls
    from quern.operators import crawl
    from quern.sources import sitemap
    from quern.sources.fetch import Fetcher, open_url
    from quern.sources.files import read_bookmarks
    from quern.sources.robots import allowed

    history = spark.read.parquet(a.history).filter("outcome = 'success'").select("url") if a.history else None
    fetch = Fetcher(delay=a.delay)
    if a.command == "collect":
        log = crawl.collect(read_bookmarks(spark, a.start), fetch, history, _split(a.lang), a.max_pages)
    else:
        def body(url: str) -> bytes | None:
            status, _, content = open_url(url)
            return content if status == 200 else None

        root = "/".join(a.start.split("/")[:3])
        rules = body(f"{root}/robots.txt")
        seeds = [] if a.no_sitemap else sitemap.discover(a.start, body, a.sitemap, a.sitemap_max)
        log = crawl.crawl(a.start, fetch, spark, history, a.depth, _split(a.lang), a.max_pages, allowed(rules.decode("utf-8", "replace") if rules else None, "quern"), seeds)
    block = text.metadata(F.col("title"), F.col("url"), F.coalesce(urls.authority(F.col("url")), F.lit("")), F.lit(date.today().isoformat()), F.col("language"))
    log.withColumn("page", F.when(F.col("outcome") == "success", F.concat(block, F.col("content")))).write.mode("append").parquet(a.out)
    crawl.summary(spark.read.parquet(a.out)).show()


def _documents(spark, a) -> None:
    """PDFs into raw pages; ``--vision`` names a callable that reads a page's image."""
    from quern.plans.ingest import ingest_folder

    call = provider(a.vision) if a.vision else None
    got = ingest_folder(spark, a.path, a.data, a.label, a.reader, call, a.password, a.max_pages, a.text_threshold, a.force_vision, a.fresh, a.jobs, date.today().isoformat())
    errors = got.pop("errors")
    print(*(f"{k.replace('_', ' ')}: {v}" for k, v in got.items()), sep="\n")
    print(*(f"error: {rel}{f' page {page}' if page else ''}: {e}" for rel, page, e in errors), sep="\n")


def _migrate(spark, a) -> None:
    """A language line for pages that have none; pages that have one stay as they are."""
    from quern.operators.pages import migrated
    from quern.sources.files import read_markdown, write_markdown
    from quern.state import cut

    pages = cut(migrated(read_markdown(spark, a.raw)), "migrated")
    print(*(f"{r['status']}: {r['count']}" for r in pages.groupBy("status").count().orderBy("status").collect()), sep="\n")
    if not a.dry_run:
        write_markdown(pages.filter("status = 'updated'"), a.raw)


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    if a.command == "export":
        from quern.sources.files import write_export

        print("files, bytes:", *write_export(a.data, a.out, not a.no_chats))
        return
    if a.command == "queries":
        from quern.plans import catalog

        print("\n".join(sorted(catalog.queries())))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quern").getOrCreate()
    if a.command in ("crawl", "collect"):
        _pages(spark, a)
        return
    if a.command in ("documents", "migrate-lang"):
        {"documents": _documents, "migrate-lang": _migrate}[a.command](spark, a)
        return
    if a.command == "run":
        from quern.plans import catalog

        catalog.queries()[a.name](spark, a.sf_dir).write.mode("overwrite").parquet(a.out)
        return
    from quern.operators import retrieval
    from quern.plans.compile import State, cached_suggestions, canonicalize_only, graph_only
    from quern.plans.folder import Files, compile_folder
    from quern.plans.prompts import prompts
    from quern.sources.files import write_graph, write_markdown

    state, call, texts = State(spark, a.state), provider(a.provider), prompts(a.language)
    if a.command == "suggestions":
        print("\n".join(cached_suggestions(state, call, a.model, texts["suggestions"])))
        return
    if a.command == "ask":
        ask = lambda messages: call("\n\n".join(m["content"] for m in messages), a.model, 4096)
        if a.events:
            from quern.streaming.answers import server_sent

            def stream(messages):  # a provider that hands out its reply in parts, or whole
                got = ask(messages)
                yield from [got] if isinstance(got, str) else got

            for kind, data in retrieval.answer_parts(a.question, state.read("articles"), state.read("nodes"), state.read("edges"), ask, stream, route=texts["route"]):
                print(server_sent({"type": kind, "data": json.dumps(data)}), end="", flush=True)
            return
        found = retrieval.answer(a.question, state.read("articles"), state.read("nodes"), state.read("edges"), ask, route=texts["route"])
        print(found["answer"], *[f"- {s}" for s in found["sources"]], sep="\n")
        return
    if a.graph_only or a.canonicalize_only:
        if a.canonicalize_only:
            got = canonicalize_only(state, call, a.model, language=a.language)
        else:
            got = graph_only(state, call if a.canonicalize else None, a.model, language=a.language)
        print("nodes, edges:", *got)
    else:
        print(compile_folder(Files(spark, a.raw), state, call, a.model, _split(a.only_domains), _split(a.lang), None, date.today().isoformat(), a.canonicalize, a.language, a.jobs, a.lint, a.model_index))
    if a.graph_dir:
        print("graph written:", *write_graph(state.read("nodes"), state.read("edges"), a.graph_dir, {"fingerprint": (state.read("meta").first() or [None])[0]}))
    if a.wiki_dir:
        print("articles written:", write_markdown(state.read("articles"), a.wiki_dir, "name"))


if __name__ == "__main__":
    main()
