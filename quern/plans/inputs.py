"""The driver's tables as the engine's inputs: raw pages, clusters, graphs, crawl logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import pages
from quern.operators.ranking import numbered_within
from quern.state import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def rel() -> F.Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def _raw(spark, sf_dir, domain, lang=None, crawled=False) -> DataFrame:
    lang = F.col("lang") if lang is None else lang
    line = F.when(lang.isNotNull(), F.concat(F.lit('language: "'), lang, F.lit('"\n'))).otherwise(F.lit(""))
    extra = F.concat(F.lit('crawled: "2026-01-'), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit('"\n')) if crawled else F.lit("")
    content = F.concat(F.lit('---\ndomain: "'), domain, F.lit('"\n'), extra, line, F.lit("---\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return documents(spark, sf_dir).select("doc_id", "text", "lang", rel().alias("rel"), content.alias("content"))


def raw_web(spark, sf_dir, **how) -> DataFrame:
    """Pages as a crawl writes them: the domain is the source."""
    return _raw(spark, sf_dir, F.col("source"), **how)


def raw_label(spark, sf_dir, **how) -> DataFrame:
    """Pages as a labelled ingest writes them: one domain, so that copies under several paths have one digest."""
    return _raw(spark, sf_dir, F.lit("handbuch"), **how)


def some_unknown() -> F.Column:
    """The language, unknown for every seventh document."""
    return F.when(F.col("doc_id") % 7 != 0, F.col("lang"))


def terms(spark, sf_dir) -> DataFrame:
    """The first words of benchmark texts as graph nodes: id, name, in sorted order."""
    first = F.lower(F.regexp_extract("text", r"^([^ .,\n]+)", 1))
    t = table(spark, sf_dir, "benchmark").select(first.alias("name")).filter("name <> ''").distinct()
    from pyspark.sql import Window

    # distinct first words of a table of stated items
    return t.withColumn("id", F.row_number().over(Window.orderBy("name")).cast("bigint")).withColumn("ord", F.col("id")).withColumn("aliases", F.array().cast("array<string>"))


def term_edges(nodes: DataFrame) -> DataFrame:
    """id to id + 1 (USES) and to id + 7 (OFFERS) where both exist."""
    n = nodes.agg(F.max("id")).first()[0] or 0
    both = nodes.select(F.col("id").alias("src"), F.explode(F.array(F.struct((F.col("id") + 1).alias("dst"), F.lit("USES").alias("rel")), F.struct((F.col("id") + 7).alias("dst"), F.lit("OFFERS").alias("rel")))).alias("e"))
    return both.select("src", "e.rel", "e.dst").filter(F.col("dst") <= n).withColumn("ord", F.col("src") * 10 + F.when(F.col("rel") == "USES", 1).otherwise(2))


def articles(spark, sf_dir, sources: list[str] | None = None) -> DataFrame:
    """All articles, or all of some sources."""
    d = documents(spark, sf_dir)
    return (d if sources is None else d.filter(F.col("source").isin(sources))).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"), "doc_id")


def graph_nodes(spark, sf_dir) -> DataFrame:
    """Regions, nations, suppliers and parts as entities: key, name, label, ord."""
    t = lambda name: table(spark, sf_dir, name)
    made = [
        t("region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("name"), F.lit("Location").alias("label"), F.col("r_regionkey").cast("bigint").alias("ord")),
        t("nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("name"), F.lit("Location").alias("label"), (F.col("n_nationkey") + 1_000).cast("bigint").alias("ord")),
        t("supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"), F.lit("Organization").alias("label"), (F.col("s_suppkey") + 1_000_000).alias("ord")),
        t("part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"), (F.col("p_partkey") + 1_000_000_000).alias("ord")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def graph_edges(spark, sf_dir) -> DataFrame:
    """LOCATED_IN and OFFERS relations by name: src, rel, dst, ord."""
    t = lambda name: table(spark, sf_dir, name)
    n, r = t("nation"), t("region")
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    a = s.select(F.col("s_name").alias("src"), F.lit("LOCATED_IN").alias("rel"), F.col("n_name").alias("dst"), F.col("s_suppkey").alias("ord"))
    b = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("LOCATED_IN").alias("rel"), F.col("r_name").alias("dst"), (F.col("n_nationkey") + 1_000_000).cast("bigint").alias("ord"))
    pairs = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    c = pairs.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    c = c.select(F.col("s_name").alias("src"), F.lit("OFFERS").alias("rel"), F.col("p_name").alias("dst"), (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey") + 2_000_000).alias("ord"))
    return a.unionByName(b).unionByName(c)


def part_nodes(spark, sf_dir) -> DataFrame:
    """Parts as entities: id, name, label, ord; every tenth names the part after it in its fullName."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"), F.col("p_partkey").alias("ord"))
    # the full name is that of the next part of the same brand and key + 1
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("name").alias("next_name"))
    p = p.join(nxt, "id", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return p.withColumn("props", F.when((F.col("id") % 10 == 0) & F.col("next_name").isNotNull(), F.create_map(F.lit("fullName"), F.col("next_name"))).otherwise(empty)).drop("next_name")


def groups(spark, sf_dir) -> DataFrame:
    return cut(pages.group_pages(raw_label(spark, sf_dir)), "groups")


def crawl_log(spark, sf_dir) -> DataFrame:
    """Events as the log of a crawl: domain, seq, outcome, code."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    failed = (F.col("user_id") % 3 == 0) | (F.col("event_type") == "error")
    code = F.when((F.col("user_id") % 3 == 0) & (F.col("k") < 70), 429).when(F.col("user_id") % 9 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, (404, 429, 403, 503, 500))), F.col("k") % 5 + 1))
    return e.select(F.col("user_id").alias("domain"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id").alias("seq"), "event_id", F.when(failed, "failed").otherwise("success").alias("outcome"), F.when(failed, code).cast("int").alias("code"))


def document_pages(spark, sf_dir) -> DataFrame:
    """Documents as the pages of one document per source, numbered by doc_id: doc, page_no, text."""
    d = documents(spark, sf_dir).select(F.col("source").alias("doc"), "text", "doc_id")
    return numbered_within(d, "doc", "doc_id", "page_no").select("doc", "page_no", "text", "doc_id")
