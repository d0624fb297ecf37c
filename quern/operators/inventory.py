"""Topic clusters: membership, pruning, changes, assignment, articles to write."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.replies import parse_json
from quern.state import cut

ASSIGN_BATCH = 25
CONTEXT_CHARS, ENTRY_CHARS = 80_000, 1500


def members(clusters: DataFrame) -> DataFrame:
    """slug, digest of ``clusters(slug, members array)``."""
    return clusters.select("slug", F.explode("members").alias("digest"))


def unassigned(distillates: DataFrame, member_rows: DataFrame) -> DataFrame:
    return distillates.select("digest").distinct().join(member_rows.select("digest"), "digest", "left_anti")


def prune(member_rows: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slug, members, fingerprint) of clusters that keep a live member, and the slugs that keep none."""
    kept = member_rows.join(live.select("digest").distinct(), "digest", "left_semi").groupBy("slug").agg(F.array_sort(F.collect_set("digest")).alias("members"))
    kept = kept.withColumn("fingerprint", text.fingerprint(F.col("members")))
    return kept, member_rows.select("slug").distinct().join(kept.select("slug"), "slug", "left_anti")


def fingerprints(member_rows: DataFrame) -> DataFrame:
    return member_rows.groupBy("slug").agg(text.fingerprint(F.collect_set("digest")).alias("fingerprint"))


#: Lanes of a multiset hash, each of 64 bits.
LANES = 4


def multiset_sums(values: DataFrame, name: str) -> DataFrame:
    """One row: n, s0 .. s3: the number of the values and sums of four parts of their SHA-256.

    Sums are the same in any order and can be added and taken away: those of a changed set are the old ones, plus those of what came, less those of what
    went. Values are summed where they lie; a task sends one row on.
    """
    h = values.select(F.sha2(F.col(name).cast("binary"), 256).alias("h"))
    lane = lambda i: F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
    return h.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(lane(i)), F.lit(0)).alias(f"s{i}") for i in range(LANES)))


def _run_hashes(batches):
    """(p, h) of rows (p, digest) in order: the SHA-256 of each run of one ``p``, its digests parted by line feeds, hashed as they come."""
    at, running = None, None
    for batch in batches:
        parts, digests = batch.column(0), batch.column(1).to_pylist()
        ends = pc.indices_nonzero(pc.not_equal(parts[:-1], parts[1:])).to_pylist() if len(parts) > 1 else []
        done = []
        for start, end in zip([0, *(e + 1 for e in ends)], [*(e + 1 for e in ends), len(parts)], strict=True):
            if start == end:
                continue
            p, body = parts[start].as_py(), "\n".join(digests[start:end]).encode()
            if running is not None and p == at:
                running.update(b"\n" + body)
                continue
            if running is not None:
                done.append((at, running.hexdigest()))
            at, running = p, hashlib.sha256(body)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["p", "h"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([running.hexdigest()], pa.string())], ["p", "h"])


def corpus_fingerprint(digests: DataFrame, schema: int = 1) -> DataFrame:
    """One row: a fingerprint of all distinct digests, whatever their order.

    A tree of two levels: all digests in sorted order are hashed by their first three hexadecimal digits, then these hashes, 4,096 at most, in theirs. One hash
    over all of them would have to see them in one task; equality means the same. Digests go through a task in order and none are held.
    """
    d = digests.filter("digest is not null").select(F.substring("digest", 8, 3).alias("p"), "digest").distinct()
    parts = d.repartition("p").sortWithinPartitions("p", "digest").mapInArrow(_run_hashes, "p string, h string")
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n").alias("x"))
    return whole.select(F.sha2(F.concat(F.lit(f"v{schema}\n"), "x").cast("binary"), 256).alias("fingerprint"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Clusters that are new or whose fingerprint differs."""
    old = before.select("slug", F.col("fingerprint").alias("_old"))
    return now.join(old, "slug", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")


def article_todo(clusters: DataFrame, changed_: DataFrame, articles: DataFrame) -> DataFrame:
    """Clusters to write: changed ones and those without an article ``<slug>.md``."""
    have = articles.select(F.regexp_replace("name", r"\.md$", "").alias("slug")).distinct()
    return clusters.select("slug").join(have, "slug", "left_anti").union(changed_.select("slug")).distinct()


def article_sources(member_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """slug, sources: paths of all members, sorted, each once."""
    return member_rows.join(groups.select("digest", F.explode("sources").alias("source")), "digest").groupBy("slug").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def orphans(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Articles of no cluster, meta articles left alone. An empty inventory orphans nothing."""
    guarded = articles.filter(~F.col("name").startswith("_")).withColumn("slug", F.regexp_replace("name", r"\.md$", ""))
    if clusters.isEmpty():
        return guarded.select("name").limit(0)
    return guarded.join(clusters.select("slug"), "slug", "left_anti").select("name")


def apply_assignments(assignments: DataFrame, clusters: DataFrame, distillates: DataFrame) -> DataFrame:
    """(slug, digest) of a reply's pairs whose slug and digest are known."""
    return assignments.join(clusters.select("slug").distinct(), "slug", "left_semi").join(distillates.select("digest").distinct(), "digest", "left_semi").select("slug", "digest").distinct()


def dominant(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The most frequent value of each key; of equals the one that comes first."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counted.groupBy(key).agg(F.max(F.struct("n", (-F.col("first")).alias("first"), value))[value].alias(value))


def context_budget(rows: DataFrame, key: str, order: str, text_col: str = "text", most: int = CONTEXT_CHARS, each: int = ENTRY_CHARS) -> DataFrame:
    """``included``: whether a page's excerpt still fits its group's budget; the sum grows with excluded ones too.

    A key may hold very many rows. They are cut into runs of ``RUN`` by order; runs are summed first, and
    only runs that begin within the budget need their rows looked at one by one.
    """
    size = F.least(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(each))
    w = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.select(key, order, size.cast("bigint").alias("_size")).withColumn("_run", F.floor(F.col(order) / RUN))
    runs = r.groupBy(key, "_run").agg(F.sum("_size").alias("_sum"))
    before = runs.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.join(before.select(key, "_run", "_before"), [key, "_run"]).withColumn("included", F.col("_before") + F.sum("_size").over(w) <= most).drop("_run", "_size", "_before")


#: Order values of one run in ``context_budget``.
RUN = 4096


def unique_slugs(rows: DataFrame, slug: str = "slug", order: str = "ord", taken: DataFrame | None = None) -> DataFrame:
    """``unique_slug``: free slugs in order of arrival: the base, else its first free suffix from 2 on. ``order`` tells rows apart.

    A name that ends in a number can be what another base would be given, so names with one stem (the name without numbers at its end) depend on each other,
    and names of different stems never do. Families of which one member only comes up, and no name is taken, are numbered in parallel, whatever
    their size. The others are settled family by family: a task goes through one family's rows in order, and holds its names only.
    """
    from quern.operators.ranking import places

    rows = rows.withColumn("_stem", F.regexp_replace(slug, r"(-[0-9]+)+$", ""))
    names = rows.select("_stem", F.col(slug).alias("_name")).distinct()
    if taken is not None:
        names = names.unionByName(taken.select(F.regexp_replace(slug, r"(-[0-9]+)+$", "").alias("_stem"), F.concat(F.lit("\n"), slug).alias("_name")).distinct())
    # taken names count as members of their own: such a family is settled in order
    odd = cut(names.groupBy("_stem").agg(F.count("*").alias("_k"), F.max(F.col("_name").startswith("\n")).alias("_t")).filter("_k > 1 or _t").select("_stem"), "odd")
    plain = places(rows.join(odd, "_stem", "left_anti"), [slug], [order], "_n")
    plain = plain.withColumn("unique_slug", F.when(F.col("_n") == 0, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), (F.col("_n") + 1).cast("string")))).drop("_n", "_stem")
    hard = rows.join(odd, "_stem", "left_semi").select("_stem", F.col(order).alias("_order"), F.col(slug).alias("_base"))
    if taken is not None:
        have = taken.select(F.regexp_replace(slug, r"(-[0-9]+)+$", "").alias("_stem"), F.lit(None).cast(dict(rows.dtypes)[order]).alias("_order"), F.col(slug).alias("_base")).distinct()
        hard = hard.unionByName(have.join(odd, "_stem", "left_semi"))
    kind = dict(rows.dtypes)[order]

    def settle(batches):
        import pyarrow as pa

        stem, used, following = None, set(), {}
        for batch in batches:
            out = []
            for s, base, taken_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != stem:
                    stem, used, following = s, set(), {}
                name = base
                if not taken_:
                    k = following.get(base, 2)  # lower numbers were found taken, and stay so
                    while name in used:
                        name, k = f"{base}-{k}", k + 1
                    following[base] = k if name != base else 2
                used.add(name)
                out.append(name)
            keep = pa.array([not t for t in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], ["_order", "unique_slug"]).filter(keep)

    ordered = hard.withColumn("_taken", F.col("_order").isNull()).repartition("_stem").sortWithinPartitions("_stem", F.desc("_taken"), "_order").select("_stem", "_order", "_base", "_taken")
    settled = ordered.mapInArrow(settle, f"_order {kind}, unique_slug string")
    both = rows.join(odd, "_stem", "left_semi").join(settled, F.col(order) == F.col("_order")).select(*plain.columns)
    return plain.unionByName(both)


def concat_inventories(parts: DataFrame) -> DataFrame:
    """One row per slug of ``parts(slug, files array, ord)``: the union of files, sorted."""
    return parts.select("slug", F.explode("files").alias("f")).groupBy("slug").agg(F.array_sort(F.collect_set("f")).alias("files"))


PART = "ord bigint, domain string, main_topics array<string>, clusters array<struct<slug:string,name:string,description:string,files:array<string>>>"
#: Pages that one call of a one-shot inventory reads; characters of a page, and of all its pages.
INVENTORY_PAGES, PAGE_CHARS = 30, 1500


def merged_inventories(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial inventories (PART) without a model: clusters (slug, name, description, files, ord) and topics (topic, ord), as one after the other would give.

    A slug's first cluster gives name and description; one that came once keeps its files as they were, else they are united and sorted. Clusters without slug go. Topics
    are compared without case, the first spelling stays. ``ord`` is dense in neither, it only orders.
    """
    c = parts.select("ord", F.posexplode("clusters").alias("k", "c")).filter("c.slug <> ''").select(F.struct("ord", "k").alias("at"), "c.*")
    files = F.coalesce("files", F.array().cast("array<string>"))
    grouped = c.groupBy("slug").agg(
        F.min("at").alias("ord"), F.min_by(F.struct("name", "description"), "at").alias("h"), F.count("*").alias("n"), F.min_by(files, "at").alias("own"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(files)))).alias("all"),
    )
    clusters = grouped.select("slug", "h.name", "h.description", F.when(F.col("n") == 1, F.col("own")).otherwise(F.col("all")).alias("files"), "ord")
    topics = parts.select("ord", F.posexplode("main_topics").alias("k", "topic")).withColumn("at", F.struct("ord", "k"))
    topics = topics.groupBy(F.lower("topic").alias("_t")).agg(F.min_by("topic", "at").alias("topic"), F.min("at").alias("ord")).drop("_t")
    return clusters, topics


def one_shot(pages: DataFrame, call: Callable[[str, str, int], str], model: str = "", prompt: str = "", merge_prompt: str = "", batch: int = INVENTORY_PAGES) -> tuple[DataFrame, DataFrame]:
    """An inventory of pages ``rel, content`` in one go: clusters (slug, name, description, files, ord) and topics (topic, ord).

    Batches of pages by path, a call for each, in parallel; their inventories are merged by calls that read a bounded number of characters, in a tree. A
    reply that is no inventory counts as none; where all are, everything is one cluster, and where merging fails the inventories are merged
    without a model.
    """
    import json

    from quern.operators.distill import numbered
    from quern.operators.reduction import READ, reduced

    spark = pages.sparkSession
    rows = numbered(pages.select("rel", F.left("content", F.lit(PAGE_CHARS)).alias("content")), batch, "rel")

    def run(frame):
        import pandas as pd

        text = "".join(f"\n### {r.rel}\n{r.content or ''}\n" for r in frame.sort_values("rel").itertuples(index=False))
        try:
            data = parse_json(call(prompt + text[:READ], model, 4096))
        except Exception:  # noqa: BLE001  the batch then has no inventory
            data = None
        good = isinstance(data, dict) and data.get("clusters")
        return pd.DataFrame({"ord": [int(frame["batch"].iloc[0])], "data": [json.dumps(data, ensure_ascii=False) if good else None]})

    made = cut(rows.groupBy("batch").applyInPandas(run, "ord bigint, data string"), "partial")
    made = made.filter("data is not null")
    n = made.count()
    if n == 0:
        files = F.array_sort(F.collect_list("rel"))
        whole = pages.agg(files.alias("files")).filter("size(files) > 0")
        clusters = whole.select(F.lit("allgemein").alias("slug"), F.lit("Allgemein").alias("name"), F.lit("Alle Inhalte").alias("description"), "files", F.struct(F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("k")).alias("ord"))
        return clusters, spark.createDataFrame([("Allgemein", (0, 0))], "topic string, ord struct<ord:bigint,k:int>")
    parsed = lambda df, text: merged_inventories(df.select("ord", F.from_json(text, PART).alias("p")).select("ord", "p.domain", "p.main_topics", "p.clusters"))
    if n > 1:
        def combine(texts: list[str], last: bool) -> str:
            reply = call(merge_prompt + "\n\n---\n\n".join(texts), model, 8192)
            if not (isinstance(parse_json(reply), dict) and parse_json(reply).get("clusters")):
                raise ValueError("no inventory")
            return json.dumps(parse_json(reply), ensure_ascii=False)

        merged = reduced(made, combine, "ord", "data", each=READ // 8)
        try:
            if json.loads(merged).get("clusters"):
                return parsed(spark.createDataFrame([(0, merged)], "ord bigint, data string"), "data")
        except (ValueError, AttributeError):
            pass  # some call failed: without a model
    return parsed(made, "data")


def ordered_distinct(rows: DataFrame, key: list[str], value: str, order: str, fold: bool = False) -> DataFrame:
    """The first row of each (key, value), values compared case-insensitively with ``fold``."""
    v = F.lower(value) if fold else F.col(value)
    return rows.withColumn("_v", v).groupBy(*key, "_v").agg(F.min(F.struct(order, value)).alias("_first")).select(*key, f"_first.{value}", f"_first.{order}")


def assign_prompt(prompt: str, clusters: list[dict], docs: list[dict]) -> str:
    """The instruction, the clusters there are, and the new documents."""
    have = [f"- {c['slug']} — {c['name']}: {c['description']}" for c in clusters] or ["(noch keine)"]
    news = [x for d in docs for x in (f"### DOC {d['digest']}", d["title"] or "", d["summary"] or "", "")]
    state = f"INVENTORY-STATE: {len(clusters) if clusters else 'EMPTY'}"
    return "\n".join([prompt, "", state, "", "Bestehende Cluster:", *have, "", "Neue Dokumente:", *news])


def py_slug(value: str | None) -> str:
    """``text.slugify`` for single values on the driver."""
    low = (value or "").strip().lower()
    for a, b in text.TRANSLITERATION.items():
        low = low.replace(a, b)
    slug = "-".join(x for x in "".join(c if c.isalnum() else "-" for c in low).split("-") if x)[: text.SLUG_LENGTH].strip("-")
    return slug or text.SLUG_DEFAULT


def assign_new(clusters: DataFrame, distillates: DataFrame, call: Callable[[str, str, int], str], model: str = "", prompt: str = "", batch_size: int = ASSIGN_BATCH) -> DataFrame:
    """Place distillates that no cluster holds; returns clusters (slug, name, description, members, fingerprint, ord).

    Serial on purpose: parallel batches would each propose a cluster for one topic. Cluster names and the new documents of
    one batch come to the driver; existing slugs never change, unplaced documents get clusters of their own.
    """
    spark = clusters.sparkSession
    new = cut(unassigned(distillates, members(clusters)).join(distillates.select("digest", "title", "summary"), "digest"), "new")
    known = [r.asDict() for r in clusters.orderBy("ord").select("slug", "name", "description").collect()]
    slugs, placed = {c["slug"] for c in known}, []

    def free(base: str) -> str:
        name, k = base, 2
        while name in slugs:
            name, k = f"{base}-{k}", k + 1
        slugs.add(name)
        return name

    rows = new.orderBy("digest").toLocalIterator()
    live = None
    while docs := [r.asDict() for _, r in zip(range(batch_size), rows)]:  # noqa: B905  a batch at a time
        try:
            data = parse_json(call(assign_prompt(prompt, known, docs), model, 4096)) or {}
            data = data if isinstance(data, dict) else {}
        except Exception:  # noqa: BLE001  the batch's documents then get clusters of their own
            data = {}
        named = {h for a in data.get("assignments", []) for h in [a.get("hash")]} | {h for c in data.get("new_clusters", []) for h in c.get("members", [])}
        inside = {d["digest"] for d in docs}
        if outside := [h for h in named - inside if isinstance(h, str)]:  # digests of other batches count where they exist
            live = distillates.filter(F.col("digest").isin(outside)).select("digest").collect()
            inside |= {r["digest"] for r in live}
        done = set()
        for a in data.get("assignments", []):
            if a.get("slug") in slugs and a.get("hash") in inside:
                placed.append((a["slug"], a["hash"]))
                done.add(a["hash"])
        for c in data.get("new_clusters", []):
            own = [h for h in c.get("members", []) if h in inside]
            if own:
                slug = free(py_slug(c.get("slug")))
                known.append({"slug": slug, "name": c.get("name") or slug, "description": c.get("description") or ""})
                placed += [(slug, h) for h in own]
                done.update(own)
        for d in docs:
            if d["digest"] not in done:
                slug = free(py_slug(d["title"]))
                known.append({"slug": slug, "name": d["title"] or slug, "description": ""})
                placed.append((slug, d["digest"]))
    named_ = spark.createDataFrame([(c["slug"], c["name"], c["description"], i) for i, c in enumerate(known)], "slug string, name string, description string, ord bigint")
    rows_ = members(clusters).unionByName(spark.createDataFrame(placed, "slug string, digest string"))
    grouped = rows_.groupBy("slug").agg(F.array_sort(F.collect_set("digest")).alias("members"))
    return named_.join(grouped, "slug", "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>"))).withColumn("fingerprint", text.fingerprint(F.col("members")))
