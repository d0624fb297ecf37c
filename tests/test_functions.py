"""Column functions on small inputs whose results are known."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.functions import html, replies, text, urls
from quern.operators import pages

PAGE = '---\ntitle: "Seite A"\nsource_url: "https://example.com/a"\ndomain: "example.com"\ncrawled: "2026-08-06"\nlanguage: "de"\n---\n\nInhalt der Seite.\n'


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


def digest(spark, content):
    return one(spark, text.content_digest(F.col("c")), c=content)


def test_digest_ignores_fetch_date_and_order(spark):
    lines = PAGE.split("\n")
    reordered = "\n".join([lines[0], lines[3], lines[2], lines[1], lines[5], lines[4], *lines[6:]])
    assert digest(spark, PAGE) == digest(spark, PAGE.replace("2026-08-06", "2027-01-01")) == digest(spark, reordered) == digest(spark, "﻿" + PAGE)
    assert len({digest(spark, x) for x in (PAGE, PAGE.replace("Seite A", "B"), PAGE.replace("Inhalt", "Text"), "Inhalt der Seite.")}) == 4
    assert digest(spark, "  bare \n") == "sha256:" + hashlib.sha256(b"bare").hexdigest()


@pytest.mark.parametrize(("value", "slug"), [("Über uns & Mehr", "ueber-uns-mehr"), ("  Straße/../x ", "strasse-x"), ("", "thema"), (None, "thema"), ("---", "thema"), ("Éàñç", "eanc"), ("a" * 59 + " b", "a" * 59)])
def test_slug(spark, value, slug):
    from quern.operators.inventory import py_slug

    assert one(spark, text.slugify(F.col("c").cast("string")), c=value) == slug == py_slug(value)


@pytest.mark.parametrize(
    ("content", "domain"),
    [(PAGE, "example.com"), ('---\nsource_url: "https://h.org:80/x"\n---\n', "h.org:80"), ("---\ndomain: 'd'\n", None), ("no block", None), ("\n ---\ndomain: q\nurl: http://z/\n---", "q"), ('---\ndomain: ""\nurl: http://z.de/\n---', "z.de")],
)
def test_domain(spark, content, domain):
    assert one(spark, text.page_domain(F.col("c")), c=content) == domain


def test_language(spark):
    assert one(spark, text.page_language(F.col("c")), c=PAGE.replace('"de"', '"DE-at"')) == "de"
    assert one(spark, text.page_language(F.col("c")), c="---\ntitle: x\n---\n") is None


@pytest.mark.parametrize(
    ("content", "sources"),
    [
        ('---\ntitle: x\nsources: ["a.md", \'b.md\', ]\n---\nbody', ["a.md", "b.md"]),
        ('---\nsources:\n  - "a.md"\n  - b.md\n---\n', ["a.md", "b.md"]),
        ("```yaml\nsources: [c.md]\n---\nbody", ["c.md"]),
        ("```yaml\n---\nsources: [c.md]\n---\nbody", ["c.md"]),
        ("```yaml\nsources: [c.md]\n```\nbody", ["c.md"]),
        ("no block\nsources: [a]", []),
        ("---\ntitle: x\n---\n", []),
    ],
)
def test_article_sources(spark, content, sources):
    assert one(spark, text.article_sources(F.col("c")), c=content) == sources


@pytest.mark.parametrize(("url", "path"), [("https://x.de/", "index.md"), ("https://x.de/a/b.html?q=1", "a/b.md"), ("https://x.de/a.b.php", "a.md"), ("https://x.de/v1.2/", "v1.md"), ("https://x.de/a/.hidden", "a/.hidden.md"), ("https://x.de/p.aspx#f", "p.md")])
def test_page_path(spark, url, path):
    assert one(spark, urls.page_path(F.col("u")), u=url) == path


def test_page_links(spark):
    doc = '<a href="/b#x">1</a><a class="k" href=\'c.html\'>2</a><a href="https://x.de/b/">3</a><a href="mailto:a@b">4</a><a href="#t">5</a><a href="//other.de/q">6</a><A HREF="//x.de/d">7</A>'
    assert one(spark, urls.page_links(F.col("h"), F.col("u")), h=doc, u="https://x.de/dir/p") == ["https://x.de/b", "https://x.de/dir/c.html", "https://x.de/d"]


LINKS = ["../x", "..", ".", "./y", "?p=2", "?p=2#f", "a/../b", "/a/./b/../c", "../../../q", "", "x y", "p;v=1", "//x.de/d/../e", "https://x.de/a/../b", "http:/odd", "/", "a//b", "/a//b", "q?x=../y", "..hidden", "a/b/..", "a/."]


@pytest.mark.parametrize("base", ["https://x.de/a/b/c.html", "https://x.de", "https://x.de/", "https://x.de/a/b/", "https://x.de/a?q=1/2", "https://x.de:80/a//b/c"])
def test_links_resolve_as_references_do(spark, base):
    from urllib.parse import urljoin

    df = spark.createDataFrame([(x,) for x in LINKS], "link string").select("link", urls.resolved(F.col("link"), F.lit(base)).alias("got"))
    clean = lambda x: x.split("#")[0].rstrip("/")
    assert {r["link"]: clean(r["got"]) for r in df.collect() if r["link"] != "http:/odd"} == {x: clean(urljoin(base, x)) for x in LINKS if x != "http:/odd"}


def test_links_unquoted_and_escaped(spark):
    doc = "<a href=./y>1</a><a href=' /q?a=1&amp;b=2 '>2</a><a data-href='/no' href=\"z\">3</a><abbr href='/no'>4</abbr><a\nclass=k\nhref=/n>5</a>"
    assert one(spark, urls.page_links(F.col("h"), F.col("u")), h=doc, u="https://x.de/d/p") == ["https://x.de/d/y", "https://x.de/q?a=1&b=2", "https://x.de/d/z", "https://x.de/n"]


def test_bookmarks(spark):
    doc = '<DT><A HREF="https://example.com/a">x</A><A HREF="javascript:1">y</A><A HREF="HTTP://foo.org/b">z</A><A HREF="place:x">w</A><A HREF="https://example.com/a">x</A>'
    assert one(spark, urls.bookmark_links(F.col("h")), h=doc) == ["https://example.com/a", "HTTP://foo.org/b"]


def test_title_and_language(spark):
    doc = '<html lang="de-AT"><head><title> A &amp; B </title></head><body><h1>H</h1></body></html>'
    assert one(spark, html.title(F.col("h"), F.col("u")), h=doc, u="https://x/y") == "A & B"
    assert one(spark, html.title(F.col("h"), F.col("u")), h="<h1>Top <b>x</b></h1>", u="https://x/y") == "Top x"
    assert one(spark, html.title(F.col("h"), F.col("u")), h="", u="https://x/y/z/") == "y/z"
    assert one(spark, html.title(F.col("h"), F.col("u")), h="", u="https://x") == "index"
    assert one(spark, html.declared_language(F.col("h")), h=doc) == "de"
    assert one(spark, html.markdown_alternate(F.col("h")), h='<link rel="alternate" type="text/markdown" href="/x.md">') == "/x.md"


def test_markdown():
    doc = "<html><head><title>t</title></head><body><nav>skip</nav><h1>Head</h1><p>Some <a href='/x'>link</a> text.</p><ul><li>a</li><li>b</li></ul><script>x()</script></body></html>"
    assert html.to_markdown(doc) == "# Head\n\nSome [link](/x) text.\n\n- a\n- b"
    assert html.to_markdown(None) is None and html.to_markdown("<p> </p>") is None
    assert html.guess_language("der Hund und die Katze sind nicht mit dem Auto auf der Straße gefahren") == "de" and html.guess_language("short") is None


def test_replies():
    assert replies.parse_json('text ```json\n{"a": 1}\n``` more') == {"a": 1} == replies.parse_json('{"a": 1}') == replies.parse_json('so: {"a": 1} ok')
    assert replies.parse_json("none") is None and replies.parse_json('{"a": [1, 2') is None
    assert replies.suggestions('```json\n["A?", 3, "B?", "C?", "D?", "E?"]\n```') == ["A?", "B?", "C?", "D?"] and replies.suggestions("x") == []


def test_pages(spark):
    raw = spark.createDataFrame([("b/2.md", PAGE), ("a/1.md", PAGE.replace("2026", "2025")), ("c/3.md", "other")], "rel string, content string")
    rows = {tuple(r["sources"]): r for r in pages.group_pages(raw).collect()}
    assert set(rows) == {("a/1.md", "b/2.md"), ("c/3.md",)} and rows["a/1.md", "b/2.md"]["domain"] == "example.com" and rows["c/3.md",]["language"] == ""
    assert one(spark, pages.with_language_line(F.col("c"), F.lit("fr")), c="---\ntitle: x\n---\nbody") == '---\ntitle: x\nlanguage: "fr"\n---\nbody'
    assert one(spark, pages.page_file(F.lit("s"), F.lit(7), F.lit(120))) == "s/seite-007.md"
    same = spark.createDataFrame([("d", 1, "https://x/a"), ("d", 2, "https://x/a?q"), ("e", 3, "https://y/a")], "domain string, seq int, url string")
    got = {r["seq"]: r["path"] for r in pages.collision_paths(same).collect()}
    assert got[1] == got[3] == "a.md" and got[2] == f"a_{hashlib.md5(b'https://x/a?q').hexdigest()[:6]}.md"
