"""Column functions over Markdown texts and their metadata block; every one stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The metadata block at the very start: three dashes, lines, three dashes, each on its own line.
BLOCK = r"(?s)^---\s*\n(.*?)\n---\s*\n"

#: How a slug writes letters with marks.
TRANSLITERATION = {
    "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss",
    "à": "a", "á": "a", "â": "a", "å": "a",
    "è": "e", "é": "e", "ê": "e", "ë": "e",
    "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ò": "o", "ó": "o", "ô": "o", "õ": "o",
    "ù": "u", "ú": "u", "û": "u",
    "ç": "c", "ñ": "n",
}
SLUG_DEFAULT = "thema"
SLUG_LENGTH = 60


def strip(c: Column) -> Column:
    """White space of every kind removed at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def norm(c: Column) -> Column:
    """Stripped and lower-cased; null as empty."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿+", "")


def block(c: Column) -> Column:
    """Lines of the metadata block; null without one."""
    t = without_bom(c)
    return F.when(t.rlike(BLOCK), F.regexp_extract(t, BLOCK, 1))


def body(c: Column) -> Column:
    """The text without its metadata block, stripped."""
    return strip(F.regexp_replace(without_bom(c), BLOCK, ""))


def content_digest(c: Column) -> Column:
    """``sha256:`` and the digest of sorted metadata lines (but ``crawled:``) and the stripped body.

    Without a metadata block, of the stripped text. Equal content has equal digests whatever the order of
    its metadata lines and whenever it was fetched.
    """
    lines = F.array_sort(F.filter(F.transform(F.split(block(c), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), strip), lambda x: (x != "") & ~x.startswith("crawled:")))
    payload = F.when(block(c).isNotNull(), F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), body(c))).otherwise(strip(without_bom(c)))
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def slugify(c: Column) -> Column:
    """A safe file name: lower case, marks written out, all but letters and digits as single dashes, 60 at most."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    for source, target in TRANSLITERATION.items():
        if len(target) > 1:
            low = F.replace(low, F.lit(source), F.lit(target))
    single = {s: t for s, t in TRANSLITERATION.items() if len(t) == 1}
    low = F.translate(low, "".join(single), "".join(single.values()))
    cut = lambda x: F.regexp_replace(x, "^-+|-+$", "")
    slug = cut(F.left(cut(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "-")), F.lit(SLUG_LENGTH)))
    return F.when(slug == "", F.lit(SLUG_DEFAULT)).otherwise(slug)


def unquoted(c: Column) -> Column:
    """A metadata value: stripped, without double and then single quotes around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), '^"+|"+$', ""), "^'+|'+$", "")


def head(c: Column) -> Column:
    """What stands between the opening dashes of a page and the next three dashes anywhere; null without both."""
    t = F.regexp_replace(c, r"(?U)^\s+", "")
    found = F.regexp_extract(t, r"(?s)^---(.*?)---", 1)
    return F.when(t.rlike(r"(?s)^---.*?---"), found)


def field(lines: Column, *names: str) -> Column:
    """The value of the first line that begins with one of the names; null without such a line."""
    pattern = r"(?m)^[ \t]*(?:" + "|".join(names) + r"):(.*)$"
    return F.when(lines.rlike(pattern), unquoted(F.regexp_extract(lines, pattern, 1)))


def page_domain(c: Column) -> Column:
    """The domain a page names, or the host (with port) of its address; null without either."""
    lines = head(c)
    host = F.try_parse_url(field(lines, "source_url", "url"), F.lit("AUTHORITY"))
    named = field(lines, "domain")
    return F.coalesce(F.when(named != "", named), F.when(host != "", host))


def page_language(c: Column) -> Column:
    """The language a page names, lower case, up to a dash; null without one."""
    value = F.split(F.lower(field(head(c), "language")), "-")[0]
    return F.when(value != "", value)


def metadata(title: Column, url: Column, domain: Column, crawled: Column, language: Column) -> Column:
    """A metadata block for a fetched page; the language line only with a language, double quotes in titles made single."""
    line = lambda name, v: F.concat(F.lit(f'{name}: "'), v, F.lit('"\n'))
    return F.concat(
        F.lit("---\n"), line("title", F.replace(title, F.lit('"'), F.lit("'"))), line("source_url", url), line("domain", domain), line("crawled", crawled),
        F.when(F.coalesce(language, F.lit("")) != "", line("language", language)).otherwise(F.lit("")), F.lit("---\n\n"),
    )


def document_metadata(title: Column, source: Column, page_no: Column, label: Column, day: Column, language: Column) -> Column:
    """A metadata block for one page of a document; the domain is the label."""
    name = F.concat(title, F.lit(" — Seite "), page_no.cast("string"))
    return metadata(name, F.concat(F.lit("file://"), source, F.lit("#page="), page_no.cast("string")), label, day, language)


def article_sources(c: Column) -> Column:
    """The source list of an article: its block opens with dashes or a yaml fence; inline list or one item a line."""
    t = F.regexp_replace(c, r"(?U)^\s+", "")
    dashes = F.regexp_extract(t, r"(?s)^---[^\n]*\n(.*?)---", 1)
    fenced = F.regexp_extract(t, r"(?s)^```yaml[^\n]*\n\n*(?:---)?(.*?)(?:---|```(?![\s\S]*---))", 1)
    lines = F.when(t.startswith("---"), dashes).when(t.startswith("```yaml"), fenced).otherwise(F.lit(""))
    inline = r"(?m)^sources:\s*\[(.*?)\]\s*$"
    several = r"(?m)^sources:[ \t]*\n((?:[ \t]+-[ \t]*.*(?:\n|\z))+)"
    from_inline = F.transform(F.filter(F.split(F.regexp_extract(lines, inline, 1), ","), lambda x: strip(x) != ""), unquoted)
    items = F.filter(F.split(F.regexp_extract(lines, several, 1), "\n"), lambda x: strip(x).startswith("-"))
    from_lines = F.filter(F.transform(items, lambda x: unquoted(F.regexp_replace(strip(x), "^-", ""))), lambda x: x != "")
    return F.when(lines.rlike(inline), from_inline).when(lines.rlike(several), from_lines).otherwise(F.array().cast("array<string>"))


def first_line(c: Column) -> Column:
    """The first line with content that is no heading, block mark or title line; empty without one."""
    good = F.filter(F.split(c, "\n"), lambda x: (strip(x) != "") & ~x.startswith("#") & ~x.startswith("---") & ~x.startswith("title:"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def fingerprint(members: Column) -> Column:
    """SHA-256 of the sorted distinct members, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\n"), 256)
