"""Sitemaps: addresses of one host from sitemap files and indexes, read on executors."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators.ranking import numbered_within

MOST, DEPTH = 5000, 3


def unpacked(content: bytes, url: str = "") -> bytes:
    """The content, gunzipped where its first bytes or its address (``.gz``) say that it is packed; nothing where that fails, as for a torn file."""
    if content[:2] != b"\x1f\x8b" and not url.lower().split("?")[0].endswith(".gz"):
        return content
    try:
        return gzip.decompress(content)
    except (OSError, EOFError, zlib.error):
        return b""


def parse(xml: str | bytes | None) -> tuple[str, list[str]]:
    """("urlset" or "sitemapindex", its locations in order); broken files hold nothing."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return "", []
    kind = root.tag.rsplit("}", 1)[-1]
    return kind, [t for e in root for x in e if x.tag.rsplit("}", 1)[-1] == "loc" and (t := (x.text or "").strip())]


def locations(files: DataFrame, most: int = MOST) -> DataFrame:
    """(domain, url, ord) of ``files(domain, xml)``: locations on the file's own host, cleaned, each once, ``most`` per host.

    The cap counts the addresses kept, lowest ``ord`` first; of equal ones (from several files of a host) any may be the last.
    """

    def run(frames):
        for frame in frames:
            rows = [(d, u, k) for d, x in zip(frame["domain"], frame["xml"], strict=True) for kind, found in [parse(x)] if kind == "urlset" for k, u in enumerate(found)]
            yield pd.DataFrame(rows, columns=["domain", "url", "ord"])

    raw = files.select("domain", "xml").mapInPandas(run, "domain string, url string, ord bigint").filter(urls.authority(F.col("url")) == F.col("domain"))
    once = raw.groupBy("domain", urls.clean_link(F.col("url")).alias("url")).agg(F.min("ord").alias("ord"))
    return numbered_within(once, "domain", "ord", "_place").filter(F.col("_place") <= most).drop("_place")


def discover(start: str, fetch: Callable[[str], bytes | None], explicit: str | None = None, most: int = MOST, depth: int = DEPTH) -> list[str]:
    """Addresses of the start's host: an explicit sitemap, else those robots.txt names, else /sitemap.xml.

    A bounded walk on the driver: indexes nest ``depth`` deep at most, and it ends at ``most`` addresses (the feature).
    """
    from urllib.parse import urlparse

    from quern.sources.robots import sitemaps

    at = urlparse(start)
    root = f"{at.scheme}://{at.netloc}"
    if explicit:
        todo = [(explicit, 0)]
    else:
        body = fetch(f"{root}/robots.txt")
        todo = [(u, 0) for u in sitemaps((body or b"").decode("utf-8", "replace"))] or [(f"{root}/sitemap.xml", 0)]
    seen, out = set(), {}
    while todo and len(out) < most:
        url, level = todo.pop(0)
        if url in seen or level > depth or (content := fetch(url)) is None:
            continue
        seen.add(url)
        kind, found = parse(unpacked(content, url))
        if kind == "sitemapindex":
            todo = [(u, level + 1) for u in found] + todo
        for u in found if kind == "urlset" else ():
            if urlparse(u).netloc == at.netloc and len(out) < most:
                out[u.split("#")[0].rstrip("/")] = None
    return list(out)
