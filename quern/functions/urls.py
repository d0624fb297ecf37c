"""Column functions over addresses and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.html import unescaped


def clean_link(c: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.split(c, "#")[0], "/+$", "")


def authority(c: Column) -> Column:
    """Host and port as written; null without one."""
    found = F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(found != "", found)


def page_path(c: Column) -> Column:
    """The file of a page: the address's path without slashes at its ends, page endings and last suffix, as ``.md``."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"\.(?:php|aspx?)$", "")
    stem = F.regexp_replace(bare, r"(?<=[^/.])\.[^./]*$", "")
    return F.when(bare == "", F.lit("index.md")).otherwise(F.concat(stem, F.lit(".md")))


def _without_dots(parts: Column) -> Column:
    """The path of some segments, the first of them empty: ``.`` left out, ``..`` with the segment before it."""
    step = lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    inner = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    kept = F.when(ends, F.concat(inner, F.array(F.lit("")))).otherwise(inner)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(link: Column, base: Column) -> Column:
    """An absolute address by the rules for references (RFC 3986): whole, from the host, from its root, from the page's folder, or a query of the page."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), F.coalesce(authority(base), F.lit("")))
    at = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path, query = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*((?:\?[^#]*)?(?:#.*)?)", 1)
    folder = F.split(F.regexp_replace(at, "[^/]*$", ""), "/")
    parts = F.concat(folder, F.split(path, "/"))
    last = F.size(parts)
    # empty segments within would only double slashes
    full = F.concat(F.array(F.lit("")), F.filter(F.slice(parts, F.lit(2), F.greatest(last - 2, F.lit(0))), lambda x: x != ""), F.array(F.element_at(parts, -1)))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, _without_dots(F.split(path, "/")), query))
        .when(link.startswith("?"), F.concat(root, at, query))
        .when(path == "", F.concat(F.regexp_extract(base, "^([^#]*)", 1), query))
        .otherwise(F.concat(root, _without_dots(full), query))
    )


def _hrefs(html: Column) -> Column:
    """Values of the href attributes of links: quoted or not, entities resolved, stripped."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)<a(?=\s)[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    plain = lambda x: F.regexp_replace(x, r"""^"|"$|^'|'$""", "")
    return F.transform(raw, lambda x: F.trim(F.regexp_replace(unescaped(plain(x)), r"^\s+|\s+$", "")))


def page_links(html: Column, url: Column) -> Column:
    """Links of a page to its own host: absolute, cleaned, each once in order of appearance; an empty link is the page itself."""
    good = F.filter(_hrefs(html), lambda x: ~x.rlike("^(?:#|mailto:|javascript:|tel:)"))
    absolute = F.transform(good, lambda x: resolved(x, url))
    own = F.filter(absolute, lambda x: authority(x) == authority(url))
    return F.array_distinct(F.transform(own, clean_link))


def bookmark_links(html: Column) -> Column:
    """Web addresses of a bookmarks file, each once in order of appearance."""
    return F.array_distinct(F.filter(_hrefs(html), lambda x: x.rlike("(?i)^https?://")))
