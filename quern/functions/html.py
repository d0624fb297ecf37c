"""Columns from HTML; conversion to Markdown runs in Arrow batches on the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import language

#: Named characters that titles use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\xa0", "&amp;": "&"}


#: The language an html tag declares.
DECLARED = r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z-]+)"""


def unescaped(c: Column) -> Column:
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def title(html: Column, url: Column) -> Column:
    """The title, else the first heading, else the address's path, else ``index``."""
    plain = lambda p: F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]*>", "")), r"^\s+|\s+$", ""))
    found = [F.when(x != "", x) for x in (plain(r"(?is)<title[^>]*>(.*?)</title>"), plain(r"(?is)<h1[^>]*>(.*?)</h1>"), F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", ""))]
    return F.coalesce(*found, F.lit("index"))


def declared_language(html: Column) -> Column:
    """The language of the html tag, lower case, up to a dash; null without one."""
    value = F.split(F.lower(F.trim(F.regexp_extract(html, DECLARED, 1))), "-")[0]
    return F.when(value != "", value)


def markdown_alternate(html: Column) -> Column:
    """The address of a Markdown version that the page names; null without one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1))
    good = F.filter(tags, lambda x: x.rlike(r"""(?i)rel\s*=\s*["']?alternate""") & x.rlike(r"""(?i)type\s*=\s*["']?text/markdown"""))
    return F.nullif(F.regexp_extract(F.get(good, F.lit(0)), r"""(?i)href\s*=\s*["']([^"']+)""", 1), F.lit(""))


@dataclass
class Block:
    """A run of text between block tags, as Markdown: its kind, the characters of its text, and how many of them are in links."""

    kind: str
    text: str
    chars: int = 0
    linked: int = 0
    framed: bool = False
    main: bool = False


class _Reader(HTMLParser):
    """The blocks of a page in order; scripts and forms are left out, the page frame (navigation, head and foot, asides) is marked."""

    SKIP = frozenset({"script", "style", "form", "noscript", "svg", "head", "template", "button", "select"})
    FRAME = frozenset({"nav", "header", "footer", "aside"})
    MAIN = frozenset({"main", "article"})
    BREAKS = frozenset({"p", "div", "section", "article", "main", "ul", "ol", "dl", "dt", "dd", "table", "blockquote", "figure", "figcaption", "body", "nav", "header", "footer", "aside"})
    HEADINGS = frozenset(f"h{k}" for k in range(1, 7))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.skip = self.frame = self.main = self.pre = 0
        self.href: list[str | None] = []
        self._open("text")

    def _open(self, kind: str, text: str = "") -> None:
        self.blocks.append(Block(kind, text, framed=self.frame > 0, main=self.main > 0))

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
            return
        # what a main part has of its own (its head, its asides) is not the page's frame
        self.frame += tag in self.FRAME and not self.main
        self.main += tag in self.MAIN and not self.frame
        if tag in self.HEADINGS:
            self._open(tag, "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._open("li", "- ")
        elif tag == "tr":
            self._open("tr", "|")
        elif tag == "pre":
            self.pre += 1
            self._open("pre", "```\n")
        elif tag in self.BREAKS:
            # a cell's or an item's own paragraphs stay in it
            if self.blocks[-1].kind != "tr" and (self.blocks[-1].kind != "li" or self.blocks[-1].chars):
                self._open("text")
            self.blocks[-1].framed, self.blocks[-1].main = self.frame > 0, self.main > 0
        elif tag == "br":
            self.blocks[-1].text += "\n"
        elif tag == "a":
            self.href.append(dict(attrs).get("href"))
            self.blocks[-1].text += "["

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th"):
            self.blocks[-1].text += " |"
        elif tag == "a" and self.href:
            self.blocks[-1].text += f"]({self.href.pop() or ''})"
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.blocks[-1].text += "\n```"
            self._open("text")
        elif tag in self.BREAKS or tag in self.HEADINGS or tag in ("li", "tr"):
            self.frame -= tag in self.FRAME and self.frame > 0 and not self.main
            self.main -= tag in self.MAIN and self.main > 0
            if tag not in self.BREAKS or self.blocks[-1].kind != "tr":
                self._open("text")

    def handle_data(self, data):
        if self.skip:
            return
        here = self.blocks[-1]
        here.text += data if self.pre else re.sub(r"\s+", " ", data)
        n = len(data.strip())
        here.chars += n
        here.linked += n if self.href else 0


#: A block of so many characters outside of links is content, one with such a share of links is not; short blocks follow their neighbours.
CONTENT_CHARS, LINK_SHARE, NEAR = 80, 0.4, 2


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks that are a page's content, in order.

    Where the page marks a main part, only that is looked at; else all but the page frame. Long blocks with few links, table rows with text and preformatted ones are
    content; the items of a list are one block. Short ones are when content stands within ``NEAR`` blocks before and after them, or on the side where there is any other block, and they
    are not mostly links. A heading is when content follows it before the next heading of its rank or a higher one. A page of which nothing is content that way
    (short pages) keeps all it has outside of the frame.
    """
    blocks = [b for b in blocks if b.chars]
    inside = [b for b in blocks if b.main]
    if sum(b.chars - b.linked for b in inside) < CONTENT_CHARS:
        inside = [b for b in blocks if not b.framed]
    # items of one list are judged together
    units: list[list[int]] = []
    for k, b in enumerate(inside):
        if b.kind == "li" and units and inside[units[-1][-1]].kind == "li" and units[-1][-1] == k - 1:
            units[-1].append(k)
        else:
            units.append([k])
    heading = [b.kind in _Reader.HEADINGS for b in inside]
    total = lambda unit, what: sum(getattr(inside[k], what) for k in unit)
    text = [u for u in units if not heading[u[0]]]  # headings do not part neighbours
    few_links = [total(u, "linked") < LINK_SHARE * total(u, "chars") for u in text]
    sure = [f and (any(inside[k].chars - inside[k].linked >= CONTENT_CHARS for k in u) or inside[u[0]].kind in ("tr", "pre")) for u, f in zip(text, few_links, strict=True)]
    if not any(sure):
        return inside
    keep = [False] * len(inside)
    for n, u in enumerate(text):
        before, after = (any(side) for side in (sure[max(0, n - NEAR) : n], sure[n + 1 : n + 1 + NEAR]))
        for k in u:
            keep[k] = sure[n] or (few_links[n] and (before or n == 0) and (after or n == len(text) - 1))
    for k in range(len(inside) - 1, -1, -1):
        if heading[k]:
            following = []
            for j in range(k + 1, len(inside)):
                if heading[j] and inside[j].kind <= inside[k].kind:
                    break
                following.append(j)
            keep[k] = inside[k].linked < inside[k].chars and any(keep[j] for j in following)
    return [b for b, k in zip(inside, keep, strict=True) if k]


def to_markdown(html: str | None) -> str | None:
    """Main content as Markdown, null without any. Not identical to what other extractors make of a page."""
    if not html:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    out, last = [], ""
    for b in main_blocks(reader.blocks):
        body = b.text if b.kind == "pre" else re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"\[\s*\]\([^)]*\)", "", b.text)).strip()
        if not body:
            continue
        out.append(("" if not out else "\n" if b.kind == last and b.kind in ("li", "tr") else "\n\n") + body)
        last = b.kind
    return "".join(out).strip() or None


def _mapped(f, c: Column | str) -> Column:
    """A function of single texts in Arrow batches; made at call time, since executors import this module without a session."""
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore").astype(object), "string")(c)


def markdown(html: Column | str) -> Column:
    return _mapped(to_markdown, html)


def guess_language(text: str | None) -> str | None:
    """The language of one text by the built-in profiles."""
    return language.built_in().guess([text])[0]


def page_language(page: str, content: str | None) -> str | None:
    """The declared language of one page, else the guessed one of its content."""
    found = re.search(DECLARED, page)
    return (found[1].lower().split("-")[0] if found else "") or guess_language(content)


def guessed_language(text: Column | str) -> Column:
    return language.guessed(text)
