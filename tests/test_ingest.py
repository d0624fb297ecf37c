"""Fetching, collecting and ingesting documents."""

from __future__ import annotations

from quern.operators import crawl
from quern.plans.compile import lint, suggested_questions
from quern.plans.ingest import BLANK, MANIFEST, ingest_documents
from quern.sources.fetch import Fetcher
from quern.sources.files import wiki_folder, wiki_languages, write_markdown

FOUND = "rel string, title string, hash string, pages_total bigint, page_no bigint, text string, png binary"


def test_fetcher_waits_and_prefers_markdown():
    waits, seen = [], []
    md = "# Titel\n" + "Text " * 20
    site = {"https://x/p": (200, {"content-type": "text/html"}, b'<link rel="alternate" type="text/markdown" href="/p.md">'), "https://x/p.md": (200, {}, md.encode()), "https://x/q": (404, {}, b"")}

    def opener(url):
        seen.append(url)
        return (429, {"retry-after": "99"}, b"") if url == "https://x/busy" or len(seen) == 1 else site[url]

    f = Fetcher(opener, 0.5, waits.append)
    assert f("https://x/p") == (200, "text/html; text/markdown", md) and waits == [0.5, 30] and f.delay == 1.0
    assert f("https://x/q")[0] == 404
    assert f("https://x/busy")[0] == 429 and f.delay == 4.0


def test_collect(spark):
    body = "<p>" + "Genug Text für eine Seite. " * 5 + "</p>"
    fetch = lambda u: (200, "text/html", body) if "ok" in u else (200, "application/pdf", "") if "pdf" in u else (500, "", "")
    wanted = spark.createDataFrame([("u/ok", 0), ("u/pdf", 1), ("u/ok", 2), ("u/bad", 3), ("u/old-ok", 4)], "url string, ord bigint")
    out = {r["url"]: (r["outcome"], r["reason"]) for r in crawl.collect(wanted, fetch, spark.createDataFrame([("u/old-ok",)], "url string")).collect()}
    assert out == {"u/ok": ("success", None), "u/pdf": ("skipped", None), "u/bad": ("failed", "HTTP 500"), "u/old-ok": ("cached", None)}


def test_documents_are_ingested_once_and_resumed(spark):
    long = "Textschicht " * 30
    rows = [("a.pdf", "A", "h", 4, 1, long, None), ("a.pdf", "A", "h", 4, 2, "", b"blank"), ("a.pdf", "A", "h", 4, 3, "", b"fail"), ("a.pdf", "A", "h", 4, 4, "", b"scan"), ("b.pdf", None, "k", 1, 1, "", b"scan")]

    def call(png):
        if png == b"fail":
            raise OSError("no")
        return BLANK if png == b"blank" else "Inhalt"

    found, empty = spark.createDataFrame(rows, FOUND), spark.createDataFrame([], MANIFEST)
    first = ingest_documents(found, empty, "buch", call, budget=3, day="2026-01-01")
    assert first.report == {"documents": 2, "pages": 5, "text_pages": 1, "vision_pages": 3, "left_out": 1, "written": 2, "failed": 1}
    assert {r["key"]: r["pages_done"] for r in first.manifest.collect()} == {"buch/a.pdf": [1, 2, 4], "buch/b.pdf": []}
    page = next(r for r in first.raw.collect() if r["rel"].endswith("seite-1.md"))
    assert 'title: "A — Seite 1"' in page["content"] and 'domain: "buch"' in page["content"] and 'source_url: "file://a.pdf#page=1"' in page["content"]
    second = ingest_documents(found, first.manifest, "buch", lambda png: "Inhalt", budget=None)
    assert second.report["pages"] == 2 and second.report["written"] == 2
    third = ingest_documents(found, second.manifest, "buch", None)
    assert third.report["pages"] == 0 and third.report["written"] == 0
    again = ingest_documents(found, second.manifest, "buch", None, fresh=True)
    assert again.report["pages"] == 5 and again.report["written"] == 1


def test_lint_suggestions_and_folders(spark, tmp_path):
    a = spark.createDataFrame([("_index.md", "Index"), ("a.md", "x" * 9000)], "name string, content string")
    seen = []
    assert lint(a, lambda p, m, n: seen.append(p) or "gut").first()["content"] == "gut" and len(seen[0]) < 4000
    assert suggested_questions(a, lambda p, m, n: '["Was?"]') == ["Was?"] and suggested_questions(a.limit(0), lambda *x: "[]") == []
    assert write_markdown(spark.createDataFrame([("wiki-de/a.md", "x"), ("wiki/b.md", "y")], "rel string, content string"), str(tmp_path)) == 2
    assert wiki_languages(str(tmp_path)) == [{"lang": "", "dir": "wiki", "default": True}, {"lang": "de", "dir": "wiki-de", "default": False}]
    assert wiki_folder(str(tmp_path), "DE").endswith("wiki-de") and wiki_folder(str(tmp_path), "fr").endswith("wiki")
