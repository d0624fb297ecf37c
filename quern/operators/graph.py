"""The knowledge graph: building, entity resolution, matching to articles, one-hop context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.replies import parse_json
from quern.functions.search import Strings
from quern.operators.ranking import places
from quern.state import cut, settings

BLOCK = 120
FACTS, DESCRIPTIONS = 40, 15
#: Bytes of terms and names that are looked for together.
TERM_BYTES = 8 << 20
#: Bytes of articles that a task takes from Spark at a time: its Python holds these, however large a partition is and however long articles are.
BATCH_BYTES = 4 << 20

#: Phrases of relations.
PHRASES = {
    "OFFERS": "bietet an",
    "USES": "nutzt",
    "DEPENDS_ON": "hängt ab von",
    "WORKS_AT": "arbeitet bei",
    "SPECIALIZES_IN": "spezialisiert sich auf",
    "LOCATED_IN": "ist ansässig in",
    "PARTNER_OF": "ist Partner von",
    "PRESENTED_AT": "präsentierte bei",
    "CERTIFIED_FOR": "ist zertifiziert für",
    "DEVELOPED_BY": "wird entwickelt von",
}
#: Properties that hold an entity's full name, the first that fits counts.
FULL_NAMES = ("fullName", "full_name", "fullname", "longname")


def merge_nodes(entities: DataFrame) -> DataFrame:
    """Nodes by trimmed name of ``entities(name, label, props, ord)``: label of the first, of each property the last value."""
    e = entities.withColumn("name", text.strip(F.coalesce("name", F.lit("")))).filter("name <> ''")
    first = e.groupBy("name").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    props = e.select("name", "ord", F.explode("props").alias("k", "v")).groupBy("name", "k").agg(F.max_by("v", "ord").alias("v"))
    props = props.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return first.join(props, "name", "left").withColumn("props", F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by node id of ``edges(src, rel, dst, ord)`` by name: dangling and self edges go, repeated ones keep the first."""
    by_name = nodes.select("id", "name")
    e = edges.select(text.strip("src").alias("s"), "rel", text.strip("dst").alias("d"), "ord")
    e = e.join(by_name.withColumnsRenamed({"id": "src", "name": "s"}), "s").join(by_name.withColumnsRenamed({"id": "dst", "name": "d"}), "d").filter("src <> dst")
    return e.groupBy("src", "rel", "dst").agg(F.min("ord").alias("ord"))


def blocks(nodes: DataFrame, size: int = BLOCK) -> DataFrame:
    """``block, chunk``: nodes by label (none: ``_``), chunks of ``size`` by normalised name where a label has more."""
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("_"))
    n = nodes.withColumn("block", label).withColumn("_norm", text.norm(F.col("name")))
    return places(n, ["block"], ["_norm", "id"], "_place").withColumn("chunk", F.floor(F.col("_place") / size)).drop("_norm", "_place")


def fullname_clusters(nodes: DataFrame) -> DataFrame:
    """(prefLabel, label, alias, a, b): node a whose full-name property is the name of node b of the same label."""
    n = nodes.withColumn("_norm", text.norm(F.col("name")))
    owner = n.groupBy("label", F.col("_norm").alias("full")).agg(F.max_by(F.struct(F.col("id").alias("b"), F.col("name").alias("prefLabel")), "ord").alias("o")).select("label", "full", "o.b", "o.prefLabel")
    keys = n.select("id", "name", "label", "_norm", "ord", F.posexplode(F.array(*[F.col("props")[k] for k in FULL_NAMES])).alias("priority", "value")).filter("value is not null").withColumn("full", text.norm(F.col("value"))).filter("full <> '' and full <> _norm")
    hit = keys.join(owner, (keys["full"] == owner["full"]) & keys["label"].eqNullSafe(owner["label"])).filter("b <> id").drop(owner["label"])
    first = hit.groupBy("id").agg(F.min(F.struct("priority", "ord", "prefLabel", "label", F.col("name").alias("alias"), "b")).alias("h")).select(F.col("id").alias("a"), "h.*")
    pair = [F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")]
    return first.select("*", *pair).groupBy("_x", "_y").agg(F.min(F.struct("ord", "prefLabel", "label", "alias", "a", "b")).alias("h")).select("h.prefLabel", "h.label", "h.alias", "h.a", "h.b")


def merge_by_preflabel(clusters: DataFrame) -> DataFrame:
    """Clusters of one label and normalised preferred name as one; ``clusters(ord, prefLabel, label, member)`` rows."""
    key = [F.coalesce("label", F.lit("")).alias("label"), text.norm(F.col("prefLabel")).alias("pref")]
    return clusters.groupBy(*key).agg(F.min_by("prefLabel", "ord").alias("prefLabel"), F.countDistinct("member").alias("n_members"), F.array_sort(F.collect_set("member")).alias("members"))


def unify_overlapping(members: DataFrame) -> DataFrame:
    """(cluster, component, pref): clusters that share a member, directly or not, are one component.

    ``members(cluster bigint, prefLabel, member)``. A component is named by its smallest cluster; its preferred name is
    that of the cluster with most members, the least of equals. Every cluster hangs on the smallest cluster of each of
    its members, so a member of many clusters makes as many links, not their square.
    """
    from quern.operators.components import components

    owner = members.groupBy("member").agg(F.min("cluster").alias("owner"))
    links = members.join(owner, "member").select(F.col("cluster").alias("u"), F.col("owner").alias("v")).distinct()
    found = components(links)
    sizes = members.groupBy("cluster").agg(F.countDistinct("member").alias("n"), F.min("prefLabel").alias("prefLabel"))
    named = sizes.join(found, sizes["cluster"] == found["node"], "left").select("cluster", "n", "prefLabel", F.coalesce("component", "cluster").alias("component"))
    named = cut(named, "named")
    pref = named.groupBy("component").agg(F.max("n").alias("_n")).join(named.select("component", "n", "prefLabel"), "component").filter("n = _n").groupBy("component").agg(F.min("prefLabel").alias("pref"))
    return named.select("cluster", "component").join(pref, "component")


def apply_clusters(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical nodes and edges.

    nodes(id, label, name, aliases, props, ord), edges(src, dst, rel, props, ord), clusters(ord, prefLabel, label, aliases,
    member_ids). Ids run from 1: clusters in their order, then nodes of no cluster. A node's properties are those of its
    members, local ones first; edges that a merge closes go, of equal edges a local one stays.
    """
    members = clusters.filter("prefLabel <> '' and label <> ''").select(F.col("ord").alias("c"), "prefLabel", "label", "aliases", F.posexplode("member_ids").alias("m", "id"))
    members = members.join(nodes.select("id", "props"), "id")
    local = F.coalesce(F.col("props")["source"] == "local", F.lit(False))
    members = cut(members.withColumn("_local", local), "members")
    heads = members.groupBy("c").agg(F.first("prefLabel").alias("name"), F.first("label").alias("label"), F.first("aliases").alias("aliases"), F.max("_local").alias("_local"))
    # of a property: the last local member's value, else the first member's
    kv = members.select("c", "m", "_local", F.explode("props").alias("k", "v")).filter("k <> 'source'")
    kv = kv.groupBy("c", "k").agg(F.max(F.when(F.col("_local"), F.struct("m", "v")))["v"].alias("_l"), F.min(F.struct("m", "v"))["v"].alias("_d")).withColumn("v", F.coalesce("_l", "_d"))
    own = kv.groupBy("c").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("p"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    heads = heads.join(own, "c", "left").select(
        F.lit(0).alias("kind"), F.col("c").alias("at"), "label", "name", F.filter(F.array_distinct("aliases"), lambda a: (a != "") & (a != F.col("name"))).alias("aliases"),
        F.map_concat(F.coalesce("p", empty), F.create_map(F.lit("source"), F.when(F.col("_local"), F.lit("local")).otherwise(F.lit("domain")))).alias("props"), F.lit(None).cast("bigint").alias("old"),
    )
    single = nodes.join(members.select("id"), "id", "left_anti").select(F.lit(1).alias("kind"), F.col("ord").alias("at"), "label", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("props", empty).alias("props"), F.col("id").alias("old"))
    new = cut(heads.unionByName(single), "canonical")
    # dense ids over two sort keys: ranked inside ranges, shifted by the counts before them
    from quern.operators.distill import numbered

    ranked = cut(numbered(new.withColumn("_key", F.struct("kind", "at")), 1, "_key", "_b").withColumn("id", F.col("_place") + 1), "ranked")
    last = members.groupBy("id").agg(F.max("c").alias("c"))  # a node of several clusters belongs to the last
    to = last.join(ranked.filter("kind = 0").select(F.col("at").alias("c"), F.col("id").alias("new")), "c").select("id", "new").unionByName(ranked.filter("kind = 1").select(F.col("old").alias("id"), F.col("id").alias("new")))
    e = edges.join(to.withColumnsRenamed({"id": "src", "new": "s"}), "src").join(to.withColumnsRenamed({"id": "dst", "new": "d"}), "dst").filter("s <> d")
    is_local = F.coalesce(F.col("props")["source"] == "local", F.lit(False))
    e = e.groupBy("s", "d", "rel").agg(F.min("ord").alias("at"), F.min_by("props", F.struct((~is_local).alias("_r"), "ord")).alias("props"))
    e = numbered(cut(e.select(F.col("s").alias("src"), F.col("d").alias("dst"), "rel", "props", "at"), "edges"), 1, "at", "_b").withColumn("id", F.col("_place") + 1)
    return ranked.select("id", "label", "name", "aliases", "props"), e.select("id", "src", "dst", "rel", "props")


def terms_of(nodes: DataFrame) -> DataFrame:
    """(term, name, place): lower-cased names and aliases with the canonical name they stand for, in order."""
    own = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return nodes.filter("name <> ''").select("ord", "name", F.posexplode(own).alias("k", "t")).filter("t <> ''").select(F.lower("t").alias("term"), "name", F.struct("ord", "k").alias("place"))


def article_entities(articles: DataFrame, terms: DataFrame, block_bytes: int = TERM_BYTES) -> DataFrame:
    """(name, entities): canonical names whose terms occur anywhere in an article, in term order; articles without are left out.

    Terms are taken in blocks of about ``block_bytes``: one block at a time is on the driver and in the tasks, its hits are written before the next one is
    looked at, and then it is let go. Meta articles (``_``) are skipped.
    """
    pages = articles.filter(~F.col("name").startswith("_")).select("name", F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    size = terms.agg(F.sum(F.octet_length("term") + F.octet_length("name"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    if n > 1:
        terms = cut(terms, "terms")
    found = None
    for k in range(n):
        part = terms if n == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k)
        one = _hits(pages, part)
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("name", "entity").agg(F.min("place").alias("place"))
    return best.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda x: x["entity"]).alias("entities"))  # at most one entry per entity


def _hits(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, entity, place): the terms of one block that occur in pages; of an entity's terms those that do, each once. Written when this returns."""
    of: dict[str, list[tuple]] = {}
    for r in terms.select("term", "name", "place").toLocalIterator():
        of.setdefault(r["term"], []).append((r["name"], r["place"]["ord"], r["place"]["k"]))
    strings, entries = [t.encode() for t in of], [e for es in of.values() for e in es]
    starts = np.concatenate([[0], np.cumsum([len(es) for es in of.values()])]).astype(np.int64)
    columns = pa.array([e[0] for e in entries], pa.string()), np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64)
    shared = pages.sparkSession.sparkContext.broadcast((pa.array(strings, pa.binary()), starts, *columns))
    del of, entries

    def run(batches):
        terms_, starts_, entity, order, k = shared.value
        strings = Strings(terms_.to_pylist())
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for row, number in strings.search(texts):
                each = starts_[number + 1] - starts_[number]
                at = np.repeat(starts_[number] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(row, each))), entity.take(pa.array(at)), pa.array(order[at]), pa.array(k[at])], ["name", "entity", "ord", "k"])

    found = pages.mapInArrow(run, "name string, entity string, ord bigint, k bigint")
    with settings(pages.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": f"{BATCH_BYTES}b"}):
        written = cut(found.select("name", "entity", F.struct("ord", F.col("k").cast("int").alias("k")).alias("place")), "hits")
    shared.destroy()
    return written


def restrict(entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that visible articles mention, and edges with both ends among them."""
    allowed = entities.select(F.explode("entities").alias("name")).distinct()
    kept = nodes.join(allowed, "name", "left_semi")
    ids = kept.select("id").distinct()
    return kept, edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def _selected_ids(selected: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    names = entities.join(selected.select("name"), "name", "left_semi").select(F.explode("entities").alias("name")).distinct()
    return nodes.join(names, "name", "left_semi").groupBy("name").agg(F.max_by("id", "ord").alias("id"))


def expand(selected: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(name, is_extra): the selected articles and one more, that mentions most neighbours of their entities, two at least."""
    ids = cut(_selected_ids(selected, entities, nodes).select("id"), "ids")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("a", "b")
    near = both.join(ids, both["a"] == ids["id"], "left_semi").select(F.col("b").alias("id")).distinct().join(ids, "id", "left_anti")
    names = nodes.join(near, "id", "left_semi").select(F.col("name").alias("entity")).distinct()
    others = entities.join(selected.select("name"), "name", "left_anti").select("name", F.explode("entities").alias("entity"))
    best = others.join(names, "entity", "left_semi").groupBy("name").agg(F.countDistinct("entity").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(1)
    return selected.select("name", F.lit(False).alias("is_extra")).unionByName(best.select("name", F.lit(True).alias("is_extra")))


def context_facts(selected: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = FACTS) -> DataFrame:
    """(ord, src, phrase, dst): edges of selected entities, those with both ends selected first, ``most`` at most."""
    ids = cut(_selected_ids(selected, entities, nodes).select("id"), "ids")
    mark = lambda k: ids.select(F.col("id").alias(k), F.lit(True).alias(f"{k}_in"))
    e = edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").filter("src_in or dst_in")
    e = e.groupBy("src", "rel", "dst").agg(F.min("ord").alias("ord"), F.first(F.coalesce(F.col("src_in") & F.col("dst_in"), F.lit(False))).alias("inside"))
    name = nodes.select("id", "name")
    e = e.join(name.withColumnsRenamed({"id": "src", "name": "s"}), "src").join(name.withColumnsRenamed({"id": "dst", "name": "d"}), "dst")
    top = e.orderBy(F.desc("inside"), "ord").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("inside"), "ord"))  # at most `most` rows
    phrase = F.coalesce(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.col("rel")], F.col("rel"))
    return top.select(place.alias("ord"), F.col("s").alias("src"), phrase.alias("phrase"), F.col("d").alias("dst"))


def context_block(facts: list[dict], descriptions: list[dict]) -> str:
    """Markdown of entity descriptions and facts; empty without either."""
    parts = []
    if descriptions:
        parts.append("\n### Entitäten\n" + "\n".join(f"- **{d['name']}**{' (' + d['label'] + ')' if d['label'] else ''}: {d['description']}" for d in descriptions))
    if facts:
        parts.append("\n### Beziehungen\n" + "\n".join(f"- {f['src']} {f['phrase']} {f['dst']}" for f in facts))
    return "\n".join(["## Wissensgraph", *parts]) if parts else ""


CLUSTER = "prefLabel string, label string, aliases array<string>, member_ids array<bigint>"


def model_clusters(nodes: DataFrame, call: Callable[[str, str, int], str], model: str = "", prompt: str = "", size: int = BLOCK) -> DataFrame:
    """Clusters that a model names, one call for each block of ids, labels and names; a failed call names none."""
    import json

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [{"id": int(i), "label": x, "name": n} for i, x, n in zip(frame["id"], frame["label"], frame["name"], strict=True)]
        try:
            data = parse_json(call(prompt + "\n" + json.dumps(rows, ensure_ascii=False), model, 8192)) or {}
            found = [c for c in data.get("clusters", []) if isinstance(c, dict)]
        except Exception:  # noqa: BLE001  the block's nodes then stay single
            found = []
        known = {r["id"] for r in rows}
        out = [(str(c.get("prefLabel") or ""), str(c.get("label") or ""), [str(a) for a in c.get("aliases") or []], [m for m in c.get("member_ids") or [] if m in known]) for c in found]
        return pd.DataFrame(out, columns=["prefLabel", "label", "aliases", "member_ids"])

    return blocks(nodes, size).groupBy("block", "chunk").applyInPandas(run, CLUSTER)  # at most `size` nodes each
