"""Every named query of the library and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import html, language, text, urls
from quern.functions.replies import suggestion_list
from quern.operators import crawl, distill, documents, graph, inventory, pages, retrieval
from quern.plans import inputs as i
from quern.state import cut

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL where there is one."""

    def wrap(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# SQL fragments
REL = "(source || '/' || doc_id || '.md')"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_LANG_LINE = "'language: \"' || lang || '\"'"
DIGEST_WEB = f"('sha256:' || sha256(concat_ws(chr(10), 'domain: \"' || source || '\"', {_LANG_LINE}) || chr(10) || chr(10) || {STRIP('coalesce(text, chr(32))')}))"
DIGEST_LABEL = f"('sha256:' || sha256(concat_ws(chr(10), 'domain: \"handbuch\"', {_LANG_LINE}) || chr(10) || chr(10) || {STRIP('coalesce(text, chr(32))')}))"
GROUPS = f"(SELECT {DIGEST_LABEL} AS digest, {REL} AS rel, lang, doc_id, source FROM documents)"
FINGERPRINT = lambda col: f"sha256(string_agg(DISTINCT {col}, chr(10) ORDER BY {col}))"
_PAIRS = (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"))


def _slug_sql(x: str) -> str:
    x = f"lower({STRIP(f'coalesce({x}, chr(32))')})"
    for a, b in _PAIRS:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"translate({x}, 'àáâåèéêëìíîïòóôõùúûçñ', 'aaaaeeeeiiiioooouuucn')"
    x = f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"
    return f"coalesce(nullif(trim(left({x}, 60), '-'), ''), 'thema')"


_UNESCAPE = lambda x: "replace(" * 5 + x + ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
TITLE = _UNESCAPE("trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's'))")
HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)"


# --- texts, addresses, pages ---


@query(f"SELECT {REL} AS rel, length(text)::BIGINT AS n_chars, {DIGEST_WEB} AS digest FROM documents")
def raw_scan(spark, sf):
    return i.raw_web(spark, sf).select("rel", F.length("text").cast("bigint").alias("n_chars"), text.content_digest(F.col("content")).alias("digest"))


@query(f"SELECT 'web/' || {REL} AS rel, {DIGEST_WEB} AS digest FROM documents UNION ALL SELECT 'label/' || {REL}, {DIGEST_LABEL} FROM documents UNION ALL SELECT 'crawled/' || {REL}, {DIGEST_WEB} FROM documents")
def content_hash(spark, sf):
    parts = [("web/", i.raw_web(spark, sf)), ("label/", i.raw_label(spark, sf)), ("crawled/", i.raw_web(spark, sf, crawled=True))]
    out = [p.select(F.concat(F.lit(k), "rel").alias("rel"), text.content_digest(F.col("content")).alias("digest")) for k, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"SELECT digest, count(*)::BIGINT AS n_sources, string_agg(rel, ',' ORDER BY rel) AS sources FROM {GROUPS} GROUP BY digest")
def group_pages(spark, sf):
    g = pages.group_pages(i.raw_label(spark, sf))
    return g.select("digest", F.size("sources").cast("bigint").alias("n_sources"), F.array_join("sources", ",").alias("sources"))


@query(f"SELECT page_id, {_slug_sql(TITLE)} AS slug FROM pages")
def slugify(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", text.slugify(html.title(F.col("html"), F.col("url"))).alias("slug"))


@query(f"SELECT {REL} AS rel, {_slug_sql('(source || chr(47) || doc_id)')} || '-' || left(sha256(source || '/' || doc_id), 6) AS slug FROM documents")
def document_slug(spark, sf):
    return i.documents(spark, sf).select(i.rel().alias("rel"), pages.document_slug(i.rel()).alias("slug"))


_PATH = "trim(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/')"
_BARE = f"regexp_replace(regexp_replace({_PATH}, '\\.html?$', ''), '\\.(php|aspx?)$', '')"


@query(
    f"""WITH p AS (SELECT page_id, url, CASE WHEN {_BARE} = '' THEN 'index.md' ELSE regexp_replace({_BARE}, '([^/.])\\.[^./]*$', '\\1') || '.md' END AS path FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS k FROM p)
SELECT page_id, CASE WHEN k = 1 THEN path ELSE regexp_replace(path, '\\.md$', '') || '_' || left(md5(url), 6) || '.md' END AS path FROM n"""
)
def raw_paths(spark, sf):
    p = i.table(spark, sf, "pages").select("page_id", "url", F.lit("all").alias("domain"), F.col("page_id").alias("seq"))
    # all hosts share one folder here, so that paths do collide; keyed by path, so no host's pages meet in one task
    return pages.collision_paths(p).select("page_id", "path")


@query(f"SELECT page_id, {TITLE} AS title, lower(split_part(regexp_extract(html, '<html[^>]*lang=\"([A-Za-z-]+)', 1), '-', 1)) AS lang, {HOST} AS domain FROM pages")
def page_titles(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", html.title(F.col("html"), F.col("url")).alias("title"), html.declared_language(F.col("html")).alias("lang"), urls.authority(F.col("url")).alias("domain"))


_LINKS = f"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), 1) AS k FROM pages),
a AS (SELECT page_id, k, regexp_replace(split_part(CASE WHEN regexp_matches(href, '^[A-Za-z]+:') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]+') || href
  ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]+') || coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', ''), ''), '/') || href END, '#', 1), '/+$', '') AS link, url FROM h
  WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|javascript:|tel:)')),
l AS (SELECT page_id, link, min(k) AS k FROM a WHERE regexp_extract(link, '^[A-Za-z]+://([^/?#]+)', 1) = {HOST} GROUP BY page_id, link),
links AS (SELECT page_id, link, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS ord FROM l)"""


@query(f"WITH {_LINKS} SELECT page_id, link, ord FROM links")
def page_links(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", F.posexplode(urls.page_links(F.col("html"), F.col("url"))).alias("ord", "link")).select("page_id", "link", "ord")


@query(f"SELECT {REL} AS rel, source AS domain, lang AS language FROM documents")
def frontmatter_domain(spark, sf):
    return i.raw_web(spark, sf).select("rel", text.page_domain(F.col("content")).alias("domain"), text.page_language(F.col("content")).alias("language"))


@query(
    f"""WITH w AS (SELECT nullif({HOST}, '') AS domain, {STRIP("url")} AS url, page_id FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY domain, url ORDER BY page_id NULLS FIRST) AS k FROM w WHERE regexp_matches(url, '^https?://', 'i'))
SELECT domain, url, (row_number() OVER (PARTITION BY domain ORDER BY page_id NULLS FIRST, url) - 1)::INTEGER AS ord FROM f WHERE k = 1"""
)
def bookmark_urls(spark, sf):
    """Web addresses of each host's export, each once, where it comes first: by page_id, then by address."""
    p = i.table(spark, sf, "pages").select(urls.authority(F.col("url")).alias("domain"), "page_id", F.regexp_replace("url", r"^\s+|\s+$", "").alias("url"))
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    anchor = F.concat(F.lit('<DT><A HREF="'), escaped, F.lit('">x</A>\n<DT><A HREF="javascript:void(0)">y</A>\n'))
    files = p.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("page_id", "url", anchor.alias("a")))).alias("x"))  # one export file per host
    doc = F.array_join(F.transform("x", lambda v: v["a"]), "")
    return files.select("domain", F.posexplode(urls.bookmark_links(F.concat(doc, doc))).alias("ord", "url")).select("domain", "url", "ord")


@query("SELECT doc_id, length(left(text, 1500))::BIGINT AS head1500, length(left(text, 2000))::BIGINT AS head2000, length(left(text, 40000))::BIGINT AS head40000 FROM documents")
def truncate(spark, sf):
    return i.documents(spark, sf).select("doc_id", *[F.length(F.left("text", F.lit(n))).cast("bigint").alias(f"head{n}") for n in (1500, 2000, 40000)])


# --- filters and counts ---


@query(f"SELECT {REL} AS rel FROM documents WHERE source IN ('src1', 'src2', 'src5')")
def filter_domains(spark, sf):
    return pages.filter_domains(pages.parsed(i.raw_web(spark, sf)), ["src1", "src2", "src5"]).select("rel")


@query(f"SELECT {REL} AS rel FROM documents WHERE doc_id % 7 = 0 OR lang IS NULL OR lang IN ('de', 'fr')")
def filter_language(spark, sf):
    return pages.filter_language(pages.parsed(i.raw_web(spark, sf, lang=i.some_unknown())), ["de", "FR"]).select("rel")


@query(f"SELECT doc_id FROM documents WHERE length({STRIP('text')}) >= 50")
def min_content(spark, sf):
    return i.documents(spark, sf).filter(pages.long_enough(F.col("text"))).select("doc_id")


@query("SELECT source AS domain, count(*)::BIGINT AS files FROM documents GROUP BY source")
def raw_domain_counts(spark, sf):
    return pages.domain_counts(pages.parsed(i.raw_web(spark, sf)))


@query("SELECT lang AS language, count(*)::BIGINT AS files FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def raw_language_counts(spark, sf):
    return pages.language_counts(pages.parsed(i.raw_web(spark, sf)))


@query("SELECT CASE WHEN doc_id % 7 <> 0 THEN 'skipped' WHEN lang IS NULL THEN 'unknown' ELSE 'updated' END AS status, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def migrate_lang_counts(spark, sf):
    p = i.raw_web(spark, sf, lang=i.some_unknown()).select(F.col("lang").alias("detected"), text.block(F.col("content")).isNotNull().alias("has_block"), text.page_language(F.col("content")).alias("language"))
    return pages.migrate_language_status(p).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS raw_count, count(*)::BIGINT AS article_count, count(DISTINCT source)::BIGINT AS domains, count(DISTINCT lang)::BIGINT AS languages FROM documents")
def corpus_stats(spark, sf):
    return retrieval.corpus_stats(pages.parsed(i.raw_web(spark, sf)), i.articles(spark, sf)).select("raw_count", "article_count", "domains", "languages")


@query(f"SELECT 'raw/' || {REL} AS rel, n_chars AS bytes FROM documents WHERE doc_id % 10 <> 3")
def export_selection(spark, sf):
    name = F.concat(F.lit("raw/"), i.rel(), F.when(F.col("doc_id") % 10 == 3, F.lit(".tmp")).otherwise(F.lit("")))
    d = i.documents(spark, sf)
    files = d.select(name.alias("rel"), F.col("n_chars").alias("bytes")).unionByName(d.select(F.concat(F.lit("chats/c"), F.col("doc_id").cast("string"), F.lit(".json")).alias("rel"), F.col("n_chars").alias("bytes")))
    return retrieval.exported(files, chats=False)


@query("SELECT source AS domain, count(*)::BIGINT AS files FROM documents WHERE source <> 'src3' GROUP BY source")
def raw_after_delete(spark, sf):
    return pages.domain_counts(pages.parsed(i.raw_web(spark, sf)).filter(~F.col("domain").eqNullSafe("src3")))


# --- incremental core ---

_STORE = f"(SELECT DISTINCT digest FROM {GROUPS} WHERE doc_id % 2 = 0)"


def _store(spark, sf):
    return i.raw_label(spark, sf).filter("doc_id % 2 = 0").select(text.content_digest(F.col("content")).alias("digest")).distinct()


@query(f"SELECT digest, count(*)::BIGINT AS n_sources, digest IN (SELECT digest FROM {_STORE}) AS cached FROM {GROUPS} GROUP BY digest")
def distill_todo(spark, sf):
    return distill.todo(pages.group_pages(i.raw_label(spark, sf)), _store(spark, sf)).select("digest", F.size("sources").cast("bigint").alias("n_sources"), "cached")


@query(
    f"""WITH t AS (SELECT DISTINCT digest FROM {GROUPS} WHERE digest NOT IN (SELECT digest FROM {_STORE})), n AS (SELECT digest, ((row_number() OVER (ORDER BY digest)) - 1) // 15 AS batch FROM t)
SELECT batch::BIGINT AS batch, count(*)::BIGINT AS n, min(digest) AS first_digest FROM n GROUP BY batch"""
)
def distill_batches(spark, sf):
    new = pages.group_pages(i.raw_label(spark, sf)).select("digest").join(_store(spark, sf), "digest", "left_anti")
    return distill.batches(cut(new, "new"))


def _member_rows(spark, sf):
    """Clusters by source."""
    return i.raw_label(spark, sf).select(F.split("rel", "/")[0].alias("slug"), text.content_digest(F.col("content")).alias("digest"), "doc_id")


@query(f"SELECT DISTINCT digest FROM {GROUPS} WHERE digest NOT IN (SELECT digest FROM {GROUPS} WHERE source IN ('src1', 'src4', 'src7'))")
def unassigned(spark, sf):
    rows = _member_rows(spark, sf)
    return inventory.unassigned(rows, rows.filter(F.col("slug").isin("src1", "src4", "src7")))


_LIVE = f"(SELECT DISTINCT digest FROM {GROUPS} WHERE doc_id IN (SELECT doc_id FROM labels) AND source <> 'src6')"


def _live(spark, sf, rows=None):
    rows = (_member_rows(spark, sf) if rows is None else rows).filter("slug <> 'src6'")
    return rows.join(i.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("digest").distinct()


@query(f"SELECT source AS slug, count(DISTINCT digest)::BIGINT AS members, {FINGERPRINT('digest')} AS fingerprint FROM {GROUPS} WHERE digest IN (SELECT digest FROM {_LIVE}) GROUP BY source")
def prune_clusters(spark, sf):
    rows = cut(_member_rows(spark, sf), "members")  # digests are made once
    kept, _ = inventory.prune(rows, _live(spark, sf, rows))
    return kept.select("slug", F.size("members").cast("bigint").alias("members"), "fingerprint")


@query(f"SELECT DISTINCT source AS slug FROM {GROUPS} WHERE source NOT IN (SELECT source FROM {GROUPS} WHERE digest IN (SELECT digest FROM {_LIVE}))")
def pruned_empty(spark, sf):
    rows = cut(_member_rows(spark, sf), "members")
    return inventory.prune(rows, _live(spark, sf, rows))[1]


_REPLY = f"(SELECT DISTINCT digest, 'src' || (('0x' || substr(digest, 8, 2))::INTEGER % 24) AS slug FROM {GROUPS})"


@query(f"SELECT slug, count(*)::BIGINT AS n FROM {_REPLY} WHERE slug IN (SELECT DISTINCT source FROM documents) GROUP BY slug")
def assign_apply(spark, sf):
    rows = _member_rows(spark, sf)
    number = F.conv(F.substring("digest", 8, 2), 16, 10).cast("int") % 24
    reply = rows.select("digest").distinct().withColumn("slug", F.concat(F.lit("src"), number.cast("string")))
    return inventory.apply_assignments(reply, rows, rows).groupBy("slug").agg(F.count("*").alias("n"))


_FP = lambda where: f"(SELECT source AS slug, {FINGERPRINT('digest')} AS fingerprint FROM {GROUPS} WHERE {where} GROUP BY source)"
_NOW, _BEFORE = _FP("doc_id % 50 <> 0"), _FP("source <> 'src9'")
_CHANGED = f"(SELECT n.slug FROM {_NOW} n LEFT JOIN {_BEFORE} b ON n.slug = b.slug WHERE b.fingerprint IS DISTINCT FROM n.fingerprint)"


def _clusters(spark, sf, where):
    return inventory.fingerprints(_member_rows(spark, sf).filter(where))


@query(f"SELECT slug FROM {_CHANGED}")
def changed_clusters(spark, sf):
    return inventory.changed(_clusters(spark, sf, "doc_id % 50 <> 0"), _clusters(spark, sf, "slug <> 'src9'")).select("slug")


@query(f"SELECT slug FROM {_NOW} WHERE slug IN (SELECT slug FROM {_CHANGED}) OR slug IN ('src2', 'src11')")
def article_todo(spark, sf):
    now = _clusters(spark, sf, "doc_id % 50 <> 0")
    have = i.documents(spark, sf).filter("source not in ('src2', 'src11')").select(F.concat("source", F.lit(".md")).alias("name")).distinct()
    return inventory.article_todo(now, inventory.changed(now, _clusters(spark, sf, "slug <> 'src9'")), have)


@query(f"SELECT a.source AS slug, string_agg(DISTINCT b.rel, ',' ORDER BY b.rel) AS sources FROM {GROUPS} a JOIN {GROUPS} b ON a.digest = b.digest GROUP BY a.source")
def article_sources(spark, sf):
    rows = _member_rows(spark, sf).select("slug", "digest").distinct()
    return inventory.article_sources(rows, pages.group_pages(i.raw_label(spark, sf))).select("slug", F.array_join("sources", ",").alias("sources"))


@query("SELECT DISTINCT source || '.md' AS name FROM documents WHERE source IN ('src0', 'src8')")
def orphan_articles(spark, sf):
    d = i.documents(spark, sf)
    articles = d.select(F.concat("source", F.lit(".md")).alias("name")).distinct().unionByName(spark.createDataFrame([("_index.md",)], "name string"))
    return inventory.orphans(articles, d.filter("source not in ('src0', 'src8')").select(F.col("source").alias("slug")).distinct())


@query(f"SELECT slug, fingerprint FROM {_FP('TRUE')}")
def cluster_fingerprint(spark, sf):
    return inventory.fingerprints(_member_rows(spark, sf))


@query(f"WITH g AS (SELECT substr(digest, 8, 3) AS p, {FINGERPRINT('digest')} AS h FROM {GROUPS} GROUP BY 1) SELECT sha256('v1' || chr(10) || coalesce(string_agg(h, chr(10) ORDER BY p), '')) AS fingerprint FROM g")
def graph_fingerprint(spark, sf):
    return inventory.corpus_fingerprint(pages.parsed(i.raw_label(spark, sf)))


@query(
    """WITH w AS (SELECT lang AS language, unnest(string_split(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'), ' ')) AS word FROM documents WHERE lang IS NOT NULL),
c AS (SELECT language, ' ' || word || ' ' AS p, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
g AS (SELECT language, n, unnest(flatten([list_transform(range(1 + CAST(k = 1 AS INT), length(p) - k + 2 - CAST(k = 1 AS INT)), lambda i: substr(p, i, k)) for k in [1, 2, 3]])) AS gram FROM c),
r AS (SELECT language, gram, sum(n) AS n FROM g GROUP BY ALL)
SELECT language, gram, rank FROM (SELECT language, gram, row_number() OVER (PARTITION BY language ORDER BY n DESC, gram) - 1 AS rank FROM r) WHERE rank < 300"""
)
def language_profiles(spark, sf):
    return language.profiles_of(i.documents(spark, sf))


@query(
    """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)
SELECT source, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM c) WHERE k = 1"""
)
def dominant_language(spark, sf):
    return inventory.dominant(i.documents(spark, sf), "source", "lang", "doc_id").withColumnRenamed("lang", "language")


@query("SELECT source, doc_id, sum(least(length(coalesce(text, '')), 1500)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 80000 AS included FROM documents")
def context_budget(spark, sf):
    return inventory.context_budget(i.documents(spark, sf), "source", "doc_id")


@query(f"WITH s AS (SELECT page_id, {_slug_sql('split_part(' + TITLE + ', chr(32), 1)')} AS slug FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS k FROM s) SELECT page_id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM n")
def unique_slugs(spark, sf):
    t = F.split(html.title(F.col("html"), F.col("url")), " ")[0]
    p = i.table(spark, sf, "pages").select(F.col("page_id").alias("ord"), text.slugify(t).alias("slug"))
    return inventory.unique_slugs(p).select(F.col("ord").alias("page_id"), F.col("unique_slug").alias("slug"))


@query(f"SELECT source AS slug, string_agg(DISTINCT {REL}, ',' ORDER BY {REL}) AS files FROM documents GROUP BY source")
def concat_inventories(spark, sf):
    d = i.documents(spark, sf).select("doc_id", F.col("source").alias("slug"), i.rel().alias("rel"))
    half = lambda w, o: d.filter(w).groupBy("slug").agg(F.collect_list("rel").alias("files")).withColumn("ord", F.lit(o))
    return inventory.concat_inventories(half("doc_id % 3 <> 0", 0).unionByName(half("doc_id % 3 <> 1", 1))).select("slug", F.array_join("files", ",").alias("files"))


@query(
    """WITH p AS (SELECT doc_id // 10 AS o, doc_id, source, lang FROM documents WHERE source IS NOT NULL),
t AS (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS topic, doc_id FROM p WHERE lang IS NOT NULL),
c AS (SELECT source AS slug, o, min(doc_id) AS least_id FROM p GROUP BY source, o)
SELECT 'cluster' AS kind, slug AS value, 'N' || min(least_id) AS name, (SELECT string_agg('f' || doc_id, ',' ORDER BY 'f' || doc_id) FROM p WHERE p.source = slug) AS files, count(*) AS n FROM c GROUP BY slug
UNION ALL SELECT 'topic', arg_min(topic, doc_id), NULL, NULL, min(doc_id) FROM t GROUP BY lower(topic)"""
)
def merged_inventories(spark, sf):
    """Partial inventories of ten documents each: a cluster a source, languages as topics in mixed case."""
    p = i.documents(spark, sf).filter("source is not null and doc_id is not null").withColumn("o", F.floor(F.col("doc_id") / 10))
    parts = p.groupBy("o", "source").agg(F.min("doc_id").alias("at"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    clusters = parts.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("at", "source", "ids"))).alias("c"))
    topic = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    topics = p.filter("lang is not null").groupBy("o").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", topic.alias("t")))), lambda x: x["t"]).alias("main_topics"))
    named = F.transform("c", lambda x: F.struct(x["source"].alias("slug"), F.concat(F.lit("N"), x["at"].cast("string")).alias("name"), F.lit("").alias("description"), F.transform(x["ids"], lambda d: F.concat(F.lit("f"), d.cast("string"))).alias("files")))
    table = clusters.join(topics, "o", "left").select(F.col("o").alias("ord"), F.lit("").alias("domain"), F.coalesce("main_topics", F.array().cast("array<string>")).alias("main_topics"), named.alias("clusters"))
    found, said = inventory.merged_inventories(table)
    n = parts.groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("n"))
    first = p.filter("lang is not null").groupBy(F.lower("lang").alias("l")).agg(F.min("doc_id").alias("n"))
    a = found.join(n, "slug").select(F.lit("cluster").alias("kind"), F.col("slug").alias("value"), "name", F.array_join(F.array_sort("files"), ",").alias("files"), "n")
    b = said.join(first, F.lower("topic") == F.col("l")).select(F.lit("topic").alias("kind"), F.col("topic").alias("value"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("files"), "n")
    return a.unionByName(b)


# --- graph and entity resolution ---

_NODES = """(SELECT 'r:' || r_regionkey AS key, r_name AS name, 'Location' AS label, r_regionkey::BIGINT AS ord FROM region
UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Location', n_nationkey + 1000 FROM nation
UNION ALL SELECT 's:' || s_suppkey, s_name, 'Organization', s_suppkey + 1000000 FROM supplier
UNION ALL SELECT 'p:' || p_partkey, p_name, p_brand, p_partkey + 1000000000 FROM part)"""
_MERGED = f"(SELECT trim(name) AS name, arg_min(label, ord) AS label, min(ord) AS ord FROM {_NODES} WHERE trim(name) <> '' GROUP BY trim(name))"
_EDGES = """(SELECT s_name AS src, 'LOCATED_IN' AS rel, n_name AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'LOCATED_IN', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, 'OFFERS', p_name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def _merged(spark, sf):
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return graph.merge_nodes(i.graph_nodes(spark, sf).withColumn("props", empty))


@query(f"SELECT ord AS id, name, label FROM {_MERGED}")
def graph_nodes(spark, sf):
    return _merged(spark, sf).select(F.col("ord").alias("id"), "name", "label")


@query(f"SELECT DISTINCT a.ord AS src, e.rel, b.ord AS dst FROM {_EDGES} e JOIN {_MERGED} a ON e.src = a.name JOIN {_MERGED} b ON e.dst = b.name WHERE a.ord <> b.ord")
def graph_edges(spark, sf):
    nodes = _merged(spark, sf).withColumn("id", F.col("ord"))
    return graph.resolve_edges(i.graph_edges(spark, sf), nodes).select("src", "rel", "dst")


@query("SELECT label, chunk::BIGINT AS chunk, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN '_' ELSE p_brand END AS label, (row_number() OVER (PARTITION BY CASE WHEN p_partkey % 11 = 0 THEN '_' ELSE p_brand END ORDER BY lower(p_name), p_partkey) - 1) // 120 AS chunk FROM part) GROUP BY label, chunk")
def er_blocks(spark, sf):
    n = i.part_nodes(spark, sf).withColumn("label", F.when(F.col("id") % 11 != 0, F.col("label")))
    return graph.blocks(n).groupBy(F.col("block").alias("label"), "chunk").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT p_partkey AS id, p_name AS name, p_brand AS label, lower(trim(p_name)) AS norm FROM part),
o AS (SELECT label, norm, arg_max(id, id) AS b, arg_max(name, id) AS pref FROM n GROUP BY label, norm),
f AS (SELECT a.id AS a, a.label, a.norm, lower(trim(x.name)) AS full_name FROM n a JOIN n x ON x.id = a.id + 1 WHERE a.id % 10 = 0)
SELECT arg_min(o.pref, f.a) AS pref, least(f.a, o.b) AS member_a, greatest(f.a, o.b) AS member_b FROM f JOIN o ON f.label = o.label AND f.full_name = o.norm WHERE f.full_name <> f.norm AND o.b <> f.a GROUP BY 2, 3"""
)
def fullname_clusters(spark, sf):
    c = graph.fullname_clusters(i.part_nodes(spark, sf))
    return c.select(F.col("prefLabel").alias("pref"), F.least("a", "b").alias("member_a"), F.greatest("a", "b").alias("member_b"))


@query("SELECT p_brand AS label, arg_min(p_name, p_partkey) AS pref, count(DISTINCT p_partkey)::BIGINT AS n_members FROM part GROUP BY p_brand, lower(trim(p_name))")
def merge_preflabel(spark, sf):
    c = i.part_nodes(spark, sf).select("ord", F.col("name").alias("prefLabel"), "label", F.col("id").alias("member"))
    return graph.merge_by_preflabel(c).select("label", F.col("prefLabel").alias("pref"), "n_members")


_MEMBERS = "(SELECT p_partkey AS cluster, p_name AS pref, p_partkey // 3 AS member FROM part UNION SELECT p_partkey, p_name, (p_partkey + 1) // 3 FROM part WHERE p_partkey % 12 <> 11)"


@query(
    f"""WITH RECURSIVE m AS (SELECT * FROM {_MEMBERS}),
l AS (SELECT DISTINCT a.cluster AS u, b.cluster AS v FROM m a JOIN m b ON a.member = b.member),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS cluster, min(v) AS component FROM r GROUP BY u),
s AS (SELECT cluster, min(pref) AS pref, count(DISTINCT member) AS n FROM m GROUP BY cluster),
t AS (SELECT component, s.pref, n, max(n) OVER (PARTITION BY component) AS top FROM s JOIN c USING (cluster))
SELECT c.component, count(*)::BIGINT AS n_members, any_value(p.pref) AS pref FROM c JOIN (SELECT component, min(pref) AS pref FROM t WHERE n = top GROUP BY component) p USING (component) GROUP BY c.component"""
)
def unify_clusters(spark, sf):
    p = i.part_nodes(spark, sf).select(F.col("id").alias("cluster"), F.col("name").alias("prefLabel"))
    third = lambda x: F.floor(x / 3).cast("bigint").alias("member")
    m = p.select("*", third(F.col("cluster"))).union(p.filter("cluster % 12 <> 11").select("*", third(F.col("cluster") + 1))).distinct()
    return graph.unify_overlapping(m).groupBy("component").agg(F.count("*").alias("n_members"), F.first("pref").alias("pref"))


# clusters of parts by brand and name, of two members at least; the cluster's order is its smallest key
_CL = "(SELECT min(p_partkey) AS c, p_brand AS label, arg_min(p_name, p_partkey) AS name, list_sort(list_distinct(list(p_name))) AS names FROM part GROUP BY p_brand, lower(trim(p_name)) HAVING count(*) > 1)"
_CANON = f"""k AS (SELECT p_partkey AS id, c.c FROM part JOIN {_CL} c ON p_brand = c.label AND lower(trim(p_name)) = lower(trim(c.name))),
cn AS (SELECT 0 AS kind, c AS pos, label, name, '' AS aliases, c AS old FROM {_CL} UNION ALL SELECT 1, p_partkey, p_brand, p_name, '', p_partkey FROM part WHERE p_partkey NOT IN (SELECT id FROM k)),
cd AS (SELECT row_number() OVER (ORDER BY kind, pos) AS id, * FROM cn),
mp AS (SELECT k.id AS old, cd.id AS new FROM k JOIN cd ON cd.kind = 0 AND cd.pos = k.c UNION ALL SELECT old, id FROM cd WHERE kind = 1)"""


def _canonical(spark, sf):
    n = i.part_nodes(spark, sf).withColumn("aliases", F.array().cast("array<string>"))
    m = graph.merge_by_preflabel(n.select("ord", F.col("name").alias("prefLabel"), "label", F.col("id").alias("member"))).filter("n_members > 1")
    clusters = m.select(F.element_at("members", 1).alias("ord"), "prefLabel", "label", F.array("prefLabel").alias("aliases"), F.col("members").alias("member_ids"))
    e = n.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") + 1, F.col("id") + 64)).alias("dst"), F.lit("USES").alias("rel"))
    e = e.withColumn("props", F.create_map(F.lit("source"), F.lit("domain"))).withColumn("ord", F.col("src") * 1000 + F.col("dst") - F.col("src"))
    return graph.apply_clusters(n, e, clusters)


@query(f"WITH {_CANON} SELECT id::BIGINT AS id, label, name, aliases FROM cd")
def canon_nodes(spark, sf):
    return _canonical(spark, sf)[0].select("id", "label", "name", F.array_join("aliases", ",").alias("aliases"))


@query(
    f"""WITH {_CANON}, e AS (SELECT a.new AS src, 'USES' AS rel, b.new AS dst, p.p_partkey * 1000 + d AS ord FROM part p CROSS JOIN (VALUES (1), (64)) v(d) JOIN mp a ON a.old = p.p_partkey JOIN mp b ON b.old = p.p_partkey + d)
SELECT (row_number() OVER (ORDER BY min(ord)))::BIGINT AS id, src::BIGINT AS src, rel, dst::BIGINT AS dst FROM e WHERE src <> dst GROUP BY src, rel, dst"""
)
def canon_edges(spark, sf):
    return _canonical(spark, sf)[1].select("id", "src", "rel", "dst")


# --- retrieval ---

_TERMS = "(SELECT name, (row_number() OVER (ORDER BY name))::BIGINT AS id FROM (SELECT DISTINCT lower(regexp_extract(text, '^([^ .,' || chr(10) || ']+)', 1)) AS name FROM benchmark) WHERE name <> '')"
_FOUND = f"(SELECT 'd' || doc_id AS name, doc_id, t.name AS entity, t.id FROM documents JOIN {_TERMS} t ON contains(lower(text), t.name))"
_ENT = f"f AS MATERIALIZED (SELECT * FROM {_FOUND}), tm AS (SELECT * FROM {_TERMS})"
_TG = "te AS (SELECT a.id AS src, 'USES' AS rel, b.id AS dst, a.id * 10 + 1 AS ord FROM tm a JOIN tm b ON b.id = a.id + 1 UNION ALL SELECT a.id, 'OFFERS', b.id, a.id * 10 + 2 FROM tm a JOIN tm b ON b.id = a.id + 7)"
_SEL = "sel AS (SELECT name FROM f GROUP BY name, doc_id HAVING count(*) = 2 ORDER BY doc_id LIMIT 3), si AS (SELECT DISTINCT id FROM f WHERE name IN (SELECT name FROM sel))"


def _entities(spark, sf):
    return graph.article_entities(i.articles(spark, sf), graph.terms_of(i.terms(spark, sf)))


def _selected(found):
    """The three lowest documents with exactly two entities."""
    return found.filter(F.size("entities") == 2).orderBy(F.substring("name", 2, 20).cast("bigint")).limit(3).select("name")


@query(f"WITH {_ENT} SELECT name, string_agg(entity, ',' ORDER BY id) AS entities FROM f GROUP BY name")
def article_entities(spark, sf):
    return _entities(spark, sf).select("name", F.array_join("entities", ",").alias("entities"))


@query("SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([source, 'src1'])), ',') END AS domains FROM documents")
def article_domains(spark, sf):
    p = pages.parsed(i.raw_web(spark, sf)).select("rel", "domain")
    # every article names its own page, one page that does not exist, and the first page of src1; every fifth names none that exists
    one = i.documents(spark, sf).filter("source = 'src1'").agg(F.min(i.rel()).alias("r")).first()["r"]
    gone = F.lit("gone/1.md")
    own = F.when(F.col("doc_id") % 5 == 0, F.array(gone)).otherwise(F.array(i.rel(), gone, F.lit(one)))
    a = i.documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), own.alias("sources"))
    return retrieval.article_domains(a, p).select("name", F.array_join("domains", ",").alias("domains"))


@query(f"WITH {_ENT}, {_TG}, v AS (SELECT DISTINCT id FROM f WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))) SELECT 'node' AS kind, id FROM v UNION ALL SELECT 'edge', ord FROM te WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def graph_restrict(spark, sf):
    """The graph of all articles of two whole sources, however many they are."""
    nodes = i.terms(spark, sf)
    a = i.articles(spark, sf, ["src1", "src2"])
    n, e = graph.restrict(graph.article_entities(a, graph.terms_of(nodes)), nodes, i.term_edges(nodes))
    return n.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), F.col("ord").alias("id")))


@query(
    f"""WITH {_ENT}, {_TG}, {_SEL}, nb AS (SELECT dst AS id FROM te WHERE src IN (SELECT id FROM si) UNION SELECT src FROM te WHERE dst IN (SELECT id FROM si)), nn AS (SELECT id FROM nb WHERE id NOT IN (SELECT id FROM si)),
x AS (SELECT name FROM f WHERE id IN (SELECT id FROM nn) AND name NOT IN (SELECT name FROM sel) GROUP BY name HAVING count(*) >= 2 ORDER BY count(*) DESC, name LIMIT 1)
SELECT name, FALSE AS is_extra FROM sel UNION ALL SELECT name, TRUE FROM x"""
)
def graph_expand(spark, sf):
    nodes, found = i.terms(spark, sf), _entities(spark, sf)
    return graph.expand(_selected(found), found, nodes, i.term_edges(nodes))


@query(
    f"""WITH {_ENT}, {_TG}, {_SEL}, e AS (SELECT te.*, src IN (SELECT id FROM si) AND dst IN (SELECT id FROM si) AS inside FROM te WHERE src IN (SELECT id FROM si) OR dst IN (SELECT id FROM si)),
n AS (SELECT row_number() OVER (ORDER BY inside DESC, ord) AS k, * FROM e)
SELECT k::INTEGER AS ord, a.name AS src, CASE n.rel WHEN 'USES' THEN 'nutzt' ELSE 'bietet an' END AS phrase, b.name AS dst FROM n JOIN tm a ON n.src = a.id JOIN tm b ON n.dst = b.id WHERE k <= 40"""
)
def graph_context_facts(spark, sf):
    nodes, found = i.terms(spark, sf), _entities(spark, sf)
    return graph.context_facts(_selected(found), found, nodes, i.term_edges(nodes))


@query(f"WITH {_ENT}, g AS (SELECT name, array_to_string(list(entity ORDER BY id)[1:5], ',') AS entities FROM f GROUP BY name) SELECT 'd' || doc_id AS name, coalesce(g.entities, '') AS entities FROM documents LEFT JOIN g ON g.name = 'd' || doc_id")
def route_listing(spark, sf):
    return retrieval.routing_list(i.articles(spark, sf), _entities(spark, sf)).select("name", F.array_join("entities", ",").alias("entities"))


@query("SELECT DISTINCT conv_id, 'd' || conv_id AS name FROM conversations WHERE conv_id % 4 <> 0 AND conv_id IN (SELECT doc_id FROM documents)")
def route_parse(spark, sf):
    c = i.table(spark, sf, "conversations").select("conv_id").distinct()
    reply = F.when(F.col("conv_id") % 4 == 0, F.lit(" None ")).otherwise(F.concat(F.lit(" d"), F.col("conv_id").cast("string"), F.lit(" , nothing-like-it,\n")))
    return retrieval.routed_names(c.withColumn("reply", reply), i.articles(spark, sf)).select("conv_id", "name")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT 'd' || doc_id AS name, left(coalesce(list_filter(x, lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(v, '#') AND NOT starts_with(v, '---') AND NOT starts_with(v, 'title:'))[1], ''), 100) AS first_line FROM l")
def wiki_index(spark, sf):
    return retrieval.index_lines(i.articles(spark, sf))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 10")
def chat_tail(spark, sf):
    return documents.tail(i.table(spark, sf, "conversations"), retrieval.WEB_TAIL).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*)::BIGINT AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def chat_list(spark, sf):
    return retrieval.chat_list(i.table(spark, sf, "conversations"))


@query(
    """WITH c AS (SELECT 'b' || conv_id % 5 AS bucket, 'c' || conv_id AS id, coalesce(left(arg_min(text, turn), 60), '') AS title, lpad(CAST(max(turn) AS VARCHAR), 6, '0') AS updated FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT bucket, id, title, updated, row_number() OVER (PARTITION BY bucket ORDER BY updated DESC, id) - 1 AS place FROM c"""
)
def chats_newest(spark, sf):
    c = i.table(spark, sf, "conversations").filter("text is not null and conv_id is not null").groupBy("conv_id").agg(F.left(F.min_by("text", "turn"), F.lit(60)).alias("title"), F.lpad(F.max("turn").cast("string"), 6, "0").alias("updated"))
    return retrieval.listed_chats(c.select(F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")).alias("bucket"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), "title", "updated"))


@query(
    f"""WITH s AS (SELECT doc_id // 4 AS a, source FROM documents WHERE source IN ('src1', 'src3', 'src8')),
v AS (SELECT a, string_agg(DISTINCT source, ',' ORDER BY source) AS d FROM s GROUP BY a)
SELECT (SELECT count(*) FROM s) AS raw_count, count(*) AS article_count, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM s) AS domains,
sha256(string_agg(a || ':' || d, chr(10) ORDER BY lpad(CAST(a AS VARCHAR), 12, '0'))) AS articles FROM v"""
)
def stats_view(spark, sf):
    """A view of three sources; articles of four documents each, named by number."""
    raw = pages.parsed(i.raw_web(spark, sf)).select("rel", "domain")
    name = F.lpad(F.floor(F.col("doc_id") / 4).cast("string"), 12, "0")
    sources = i.documents(spark, sf).filter("doc_id is not null").groupBy(name.alias("name")).agg(F.collect_list(i.rel()).alias("sources"))
    row = retrieval.stats_view(raw, sources.select("name", F.lit("").alias("content")), sources, ["src1", "src3", "src8"])
    line = F.transform("articles", lambda a: F.concat(a["name"].cast("bigint").cast("string"), F.lit(":"), F.array_join(a["domains"], ",")))
    return row.select("raw_count", "article_count", F.array_join("domains", ",").alias("domains"), F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("articles"))


# --- crawl and documents ---


@query(f"WITH {_LINKS} SELECT DISTINCT 1 AS depth, link AS url FROM links WHERE link NOT IN (SELECT url FROM pages)")
def crawl_frontier(spark, sf):
    p = i.table(spark, sf, "pages")
    links = p.select(F.lit(1).alias("depth"), F.col("page_id").alias("parent_ord"), F.posexplode(urls.page_links(F.col("html"), F.col("url"))).alias("link_ord", "url"))
    return crawl.next_frontier(links, p).select("depth", "url")


@query("SELECT url, CASE WHEN url IS NOT NULL AND bool_or(page_id % 2 = 0) THEN 'cached' ELSE 'fetch' END AS outcome FROM pages GROUP BY url")
def collect_plan(spark, sf):
    p = i.table(spark, sf, "pages").select("url", F.col("page_id").alias("ord"), "page_id")
    return crawl.collect_plan(p.unionByName(p), p.filter("page_id % 2 = 0")).select("url", "outcome")


_LOG = """(SELECT user_id AS domain, ts, event_id, CASE WHEN user_id % 3 = 0 OR event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome,
CASE WHEN NOT (user_id % 3 = 0 OR event_type = 'error') THEN NULL WHEN user_id % 3 = 0 AND k < 70 THEN 429 WHEN user_id % 9 = 0 THEN NULL ELSE [404, 429, 403, 503, 500][k % 5 + 1] END AS code
FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events))"""


@query(f"WITH n AS (SELECT *, coalesce(sum((outcome = 'success')::INTEGER) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM {_LOG}) SELECT domain, outcome, count(*)::BIGINT AS n FROM n WHERE done < 40 GROUP BY domain, outcome")
def crawl_outcomes(spark, sf):
    return crawl.outcomes(i.crawl_log(spark, sf), max_pages=40)


@query(f"SELECT outcome, count(*)::BIGINT AS n FROM {_LOG} GROUP BY outcome")
def crawl_summary(spark, sf):
    return crawl.summary(i.crawl_log(spark, sf))


@query(
    f"""WITH a AS (SELECT *, coalesce(code = 429, FALSE) AS hit FROM {_LOG} WHERE code IS NOT NULL OR outcome = 'success'),
r AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY domain, run ORDER BY ts, event_id) AS k FROM r WHERE hit),
o AS (SELECT domain, event_id, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS j FROM n WHERE k = 5)
SELECT domain, event_id AS abort_event FROM o WHERE j = 1"""
)
def crawl_429_abort(spark, sf):
    return crawl.abort_points(i.crawl_log(spark, sf)).select("domain", F.col("abort_seq.event_id").alias("abort_event"))


@query(
    f"""WITH l AS (SELECT * FROM {_LOG}), t AS (SELECT domain, count(*) FILTER (outcome = 'success') AS ok, count(*) FILTER (outcome = 'failed') AS failed FROM l GROUP BY domain),
c AS (SELECT domain, code, count(*) AS n, min(struct_pack(ts := ts, e := event_id)) AS first FROM l WHERE outcome = 'failed' AND code IS NOT NULL GROUP BY domain, code),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, first) AS j FROM c),
x AS (SELECT t.*, k.code, k.n, coalesce((ok = 0 OR ok / (ok + failed) < 0.05) AND n >= greatest(3.0, 0.5 * failed), FALSE) AS blocked FROM t LEFT JOIN k ON t.domain = k.domain AND k.j = 1)
SELECT domain, ok::BIGINT AS ok, failed::BIGINT AS failed, blocked,
CASE WHEN blocked THEN CASE WHEN code = 429 THEN 'Rate-Limit (HTTP 429)' WHEN code = 503 THEN 'Dienst nicht verfügbar / Bot-Schutz (HTTP 503)' WHEN code IN (401, 403, 407) THEN 'WAF/Bot-Schutz (HTTP ' || code || ')' ELSE 'HTTP ' || code END || ' — ' || n || '/' || failed || ' URLs geblockt' END AS reason,
CASE WHEN blocked THEN code::VARCHAR END AS top_status FROM x"""
)
def crawl_block_status(spark, sf):
    # as text: the two engines hand nullable integers to the comparison in different types
    return crawl.block_status(i.crawl_log(spark, sf)).withColumn("top_status", F.col("top_status").cast("string"))


@query(
    f"""WITH x AS (SELECT {HOST} AS domain, regexp_replace(split_part(url, '#', 1), '/+$', '') AS url, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS ord FROM pages),
m AS (SELECT domain, url, min(ord) AS ord FROM x GROUP BY domain, url), n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS k FROM m)
SELECT domain, url, ord::BIGINT AS ord FROM n WHERE k <= 5000"""
)
def sitemap_urls(spark, sf):
    from quern.sources import sitemap

    p = i.table(spark, sf, "pages").select(urls.authority(F.col("url")).alias("domain"), "url", "page_id")
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    files = p.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("x")))), lambda v: v["x"]), "").alias("x"))
    files = files.select("domain", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.lit("</urlset>")).alias("xml"))
    return sitemap.locations(files).select("domain", "url", "ord")


_ROUTE = f"(SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, CASE WHEN length({STRIP('coalesce(text, chr(32))')}) >= 900 THEN 'text' ELSE 'vision' END AS route FROM documents)"
_INCL = f"(SELECT *, route = 'text' OR sum((route = 'vision')::INTEGER) OVER (ORDER BY doc, page_no ROWS UNBOUNDED PRECEDING) <= 60 AS included FROM {_ROUTE})"


def _routed(spark, sf):
    return documents.routed(i.document_pages(spark, sf), threshold=900)


@query(f"SELECT doc, page_no::BIGINT AS page_no, route FROM {_ROUTE}")
def page_routing(spark, sf):
    return _routed(spark, sf).select("doc", "page_no", "route")


@query(f"SELECT doc, page_no::BIGINT AS page_no, included FROM {_INCL}")
def vision_budget(spark, sf):
    return documents.budgeted(_routed(spark, sf), 60).select("doc", "page_no", "included")


@query(f"SELECT count(DISTINCT doc)::BIGINT AS documents, count(*)::BIGINT AS pages, count(*) FILTER (route = 'text')::BIGINT AS text_pages, count(*) FILTER (route = 'vision' AND included)::BIGINT AS vision_pages, count(*) FILTER (NOT included)::BIGINT AS left_out FROM {_INCL}")
def ingest_report(spark, sf):
    return documents.report(documents.budgeted(_routed(spark, sf), 60))


@query(
    """WITH d AS (SELECT source AS doc, count(*) AS n FROM documents GROUP BY source)
SELECT doc, array_to_string(CASE WHEN doc IN ('src1', 'src2', 'src3') THEN range(1, n + 1) ELSE range(2, n + 1, 2) END, ',') AS pending FROM d"""
)
def pending_pages(spark, sf):
    d = i.documents(spark, sf).groupBy(F.col("source").alias("key")).agg(F.count("*").alias("pages_total")).withColumn("hash", F.sha2("key", 256))
    odd = F.filter(F.sequence(F.lit(1).cast("bigint"), "pages_total"), lambda x: x % 2 == 1)
    was = F.when(F.col("key").isin("src1", "src2", "src3"), F.lit("other")).otherwise(F.col("hash"))
    m = d.select("key", was.alias("hash"), "pages_total", odd.alias("pages_done"))
    return documents.pending(d, m).select(F.col("key").alias("doc"), F.array_join(F.transform("pending", lambda x: x.cast("string")), ",").alias("pending"))


@query(
    """WITH c AS (SELECT conv_id, turn, [left(text, 60), text, '', 'One? ', role || '?', 'Two?', 'Three?'] AS x FROM conversations WHERE turn % 3 <> 2)
SELECT conv_id, turn, unnest(list_transform(list_filter(x, lambda v: v IS NOT NULL AND trim(v, E' \\n\\t') <> '' AND length(trim(v, E' \\n\\t')) <= 120), lambda v: trim(v, E' \\n\\t'))[1:4]) AS question FROM c"""
)
def suggestions_parse(spark, sf):
    """Each message as a model's reply: a fenced list, a list within prose, or none at all."""
    c = i.table(spark, sf, "conversations")
    found = F.to_json(F.array(F.left("text", F.lit(60)), "text", F.lit(""), F.lit("One? "), F.concat("role", F.lit("?")), F.lit("Two?"), F.lit("Three?")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), found, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here they are: "), found, F.lit(" (done)"))).otherwise("none")
    return c.select("conv_id", "turn", F.explode(suggestion_list(reply)).alias("question"))
