"""Raw pages: grouping by content, filters, counts, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import html, text, urls

MIN_CHARS = 50


def parsed(raw: DataFrame) -> DataFrame:
    """Raw pages ``rel, content`` with domain, language and digest."""
    return raw.select("rel", "content", text.page_domain(F.col("content")).alias("domain"), text.page_language(F.col("content")).alias("language"), text.content_digest(F.col("content")).alias("digest"))


def group_pages(raw: DataFrame, with_content: bool = False) -> DataFrame:
    """One row per digest: sources in path order; domain, language (and content) of the first path.

    The first path's values come with it through a map-side minimum, so contents of copies are not gathered.
    """
    p = parsed(raw)
    first = F.min(F.struct("rel", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("language", F.lit("")).alias("language"), *(["content"] if with_content else [])))
    g = p.groupBy("digest").agg(F.array_sort(F.collect_list("rel")).alias("sources"), first.alias("first"))
    return g.select("digest", "sources", "first.domain", "first.language", *(["first.content"] if with_content else []))


def filter_domains(raw: DataFrame, allowed: list[str] | None) -> DataFrame:
    """None passes all; otherwise pages of exactly these domains, pages without a domain are dropped."""
    return raw if allowed is None else raw.filter(F.col("domain").isin(allowed))


def filter_language(pages: DataFrame, langs: list[str] | None, detect: bool = False) -> DataFrame:
    """Pages whose language is wanted or unknown. Detection runs only on pages that declare none."""
    if not langs:
        return pages
    wanted = {x.lower() for x in langs}
    known = pages.filter(F.col("language").isNotNull() & F.col("language").isin(list(wanted)))
    unknown = pages.filter("language is null")
    if detect:
        guess = html.guessed_language(text.body(F.col("content")))
        unknown = unknown.withColumn("_guess", guess).filter(F.col("_guess").isNull() | F.col("_guess").isin(list(wanted))).drop("_guess")
    return known.unionByName(unknown)


def dropped_by_language(pages: DataFrame, kept: DataFrame) -> int:
    return pages.count() - kept.count()


def long_enough(c) -> F.Column:
    return F.length(text.strip(F.coalesce(c, F.lit("")))) >= MIN_CHARS


def domain_counts(pages: DataFrame) -> DataFrame:
    return pages.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("files"))


def language_counts(pages: DataFrame) -> DataFrame:
    return pages.filter("language is not null").groupBy("language").agg(F.count("*").alias("files"))


def migrate_language_status(pages: DataFrame) -> DataFrame:
    """What adding languages would do to each page: no_frontmatter, skipped (has one), unknown (none found) or updated."""
    return pages.withColumn("status", F.when(~F.col("has_block"), "no_frontmatter").when(F.col("language").isNotNull(), "skipped").when(F.col("detected").isNull(), "unknown").otherwise("updated"))


def migrated(raw: DataFrame) -> DataFrame:
    """``raw(rel, content)`` with status, as in ``migrate_language_status``, and for updated pages the new content."""
    from quern.functions import html

    block = text.without_bom(F.col("content")).rlike(text.BLOCK)
    body = F.regexp_replace(text.without_bom(F.col("content")), text.BLOCK, "")
    pages = raw.select("rel", "content", block.alias("has_block"), text.page_language(F.col("content")).alias("language"), body.alias("body"))
    found = migrate_language_status(pages.withColumn("detected", html.guessed_language("body")))
    return found.withColumn("content", F.when(F.col("status") == "updated", with_language_line(F.col("content"), F.col("detected"))).otherwise(F.col("content"))).select("rel", "content", "status")


def with_language_line(content: F.Column, language: F.Column) -> F.Column:
    """The page with a language line at the end of its metadata block."""
    t = text.without_bom(content)
    return F.when(t.rlike(text.BLOCK), F.concat(F.regexp_extract(t, r"(?s)^(---\s*\n.*?\n)---\s*\n", 1), F.lit('language: "'), language, F.lit('"\n'), F.regexp_extract(t, r"(?s)^---\s*\n.*?\n(---\s*\n.*)$", 1))).otherwise(content)


def collision_paths(pages: DataFrame, host: str = "domain", order: str = "seq") -> DataFrame:
    """Paths of fetched pages below their host: the first page of a path keeps it, later ones get six digits of their address's MD5."""
    base = pages.withColumn("_path", urls.page_path(F.col("url")))
    suffix = F.concat(F.regexp_replace("_path", r"\.md$", ""), F.lit("_"), F.left(F.md5("url"), F.lit(6)), F.lit(".md"))
    # the first of a path is all that must be known of it: a minimum, however many pages share it
    first = base.groupBy(host, "_path").agg(F.min(order).alias("_first"))
    found = base.join(first, base[host].eqNullSafe(first[host]) & base["_path"].eqNullSafe(first["_path"]), "left").select(base["*"], "_first")
    return found.withColumn("path", F.when(F.col(order) == F.col("_first"), F.col("_path")).otherwise(suffix)).drop("_path", "_first")


def document_slug(rel: F.Column) -> F.Column:
    """Slug of a document's path without suffix, and six digits of that path's SHA-256."""
    stem = F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(text.slugify(stem), F.lit("-"), F.left(F.sha2(stem, 256), F.lit(6)))


def page_file(slug: F.Column, page_no: F.Column, total: F.Column) -> F.Column:
    """File of a document's page, its number padded to the width of the last one."""
    return F.concat(slug, F.lit("/seite-"), F.lpad(page_no.cast("string"), F.length(total.cast("string")), F.lit("0")), F.lit(".md"))
