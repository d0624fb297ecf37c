"""The compile run: distil, assign, write, connect; each step touches only what changed.

State is a folder of Parquet versions. A version counts once its marker file exists, which is made after all its tables are
complete; the highest one that counts is the current one. Nothing is ever moved or pointed elsewhere: a run that dies leaves the state before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import distill, graph, inventory, pages, retrieval
from quern.plans.prompts import prompts as default_prompts

CLUSTERS = "slug string, name string, description string, ord bigint, members array<string>, fingerprint string"
ARTICLES = "name string, content string"
STORE = "digest string, title string, summary string, keypoints array<string>, entities array<struct<name:string,label:string,props:map<string,string>>>, edges array<struct<src:string,rel:string,dst:string>>, sources array<string>, domain string, language string"
NODES = "id bigint, label string, name string, aliases array<string>, props map<string,string>, ord bigint"
EDGES = "id bigint, src bigint, dst bigint, rel string, props map<string,string>, ord bigint"
META = "fingerprint string"
TABLES = {"store": STORE, "clusters": CLUSTERS, "articles": ARTICLES, "nodes": NODES, "edges": EDGES, "meta": META}

Call = Callable[[str, str, int], str]
#: The file that makes a version count, and how many versions stay.
MARKER, KEEP = "_COMPLETE", 2


class State:
    """Versioned tables below one folder of any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables or TABLES
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all complete versions, rising."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        numbers = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [n for n in numbers if self.fs.exists(self.path(f"{self.root}/v={n}/{MARKER}"))]

    def version(self) -> int | None:
        """The current version; none before the first run."""
        return (self.versions() or [None])[-1]

    def complete(self, version: int, keep: int = KEEP) -> None:
        """Let a version count whose tables are all written; all but the last ``keep`` complete ones are deleted."""
        self.fs.create(self.path(f"{self.root}/v={version}/{MARKER}"), True).close()
        for old in self.versions()[:-keep]:
            self.fs.delete(self.path(f"{self.root}/v={old}/{MARKER}"), False)
            self.fs.delete(self.path(f"{self.root}/v={old}"), True)

    def note(self, name: str, value: dict | None = None) -> dict:
        """A small JSON note beside the versions: read, or written where a value is given; a missing or torn one is empty."""
        at = self.path(f"{self.root}/{name}.json")
        if value is not None:
            out = self.fs.create(at, True)
            out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
            out.close()
            return value
        if not self.fs.exists(at):
            return {}
        stream = self.fs.open(at)
        raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            return {}

    def read(self, table: str) -> DataFrame:
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], self.tables[table])
        return self.spark.read.schema(self.tables[table]).parquet(f"{self.root}/v={v}/{table}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """All tables as the next version; those not given are kept from the current one."""
        v = self.version()
        new = 0 if v is None else v + 1
        for name, kind in self.tables.items():
            df = tables[name] if name in tables else self.read(name)
            want = [c.split(" ")[0] for c in _columns(kind)]
            df.select(*want).write.mode("overwrite").parquet(f"{self.root}/v={new}/{name}")
        self.complete(new)
        return new


def _columns(ddl: str) -> list[str]:
    """Columns of a DDL string, parted at commas outside of brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k].strip())
            start = k + 1
    return [*out, ddl[start:].strip()]


@dataclass
class Report:
    """What a run did."""

    pages: int = 0
    distilled: int = 0
    failed: int = 0
    changed: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    graph_built: bool = False
    index_built: bool = False


def article_prompt(prompt: str, name: str, language: str, entries: list[str]) -> str:
    return "\n".join([prompt, f"Thema: {name}", f"Sprache: {language or 'unbekannt'}", *entries])


def write_articles(todo: DataFrame, clusters: DataFrame, distillates: DataFrame, call: Call, model: str = "", prompt: str = "", today: str = "") -> DataFrame:
    """(name, content) of the clusters to write, from all their members, in parallel tasks; failed calls write nothing.

    Of each cluster only its excerpts within the context budget reach the call.
    """
    from quern.operators.ranking import places, running_sum
    from quern.state import cut

    rows = inventory.members(clusters.join(todo.select("slug").distinct(), "slug", "left_semi")).join(distillates, "digest")
    entry = F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("title", F.lit(""))), "summary", F.array_join("keypoints", "\n"))
    rows = cut(rows.select("slug", "digest", "language", "sources", F.left(entry, F.lit(inventory.ENTRY_CHARS)).alias("entry")), "entries")
    # the running size within a cluster decides what its prompt holds; it is summed over numbers alone, however large the cluster
    sizes = places(rows.select("slug", "digest", F.length("entry").alias("size")), ["slug"], ["digest"], "place")
    used = running_sum(sizes, ["slug"], "place", F.floor(F.col("place") / 4096), F.col("size"), "used")
    fit = rows.join(used.filter((F.col("used") <= inventory.CONTEXT_CHARS) & (F.col("size") > 0)).select("slug", "digest"), ["slug", "digest"])
    entries = fit.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("digest", F.col("entry").alias("e")))).alias("entries"))  # of a bounded size
    lang = inventory.dominant(rows.filter("language <> ''").withColumn("p", F.xxhash64("digest")), "slug", "language", "p")
    sources = rows.select("slug", F.explode_outer("sources").alias("s")).groupBy("slug").agg(F.array_sort(F.collect_set("s")).alias("sources"))  # what the article itself lists
    named = sources.join(entries, "slug", "left").join(lang, "slug", "left").join(clusters.select("slug", "name"), "slug")

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    body = call(article_prompt(prompt, r.name, r.language, [e["e"] for e in (r.entries if r.entries is not None else [])]), model, 8192)
                except Exception:  # noqa: BLE001  the article stays due for the next run
                    continue
                out.append((f"{r.slug}.md", retrieval.ensured_metadata(body, r.name, list(r.sources), today)))
            yield pd.DataFrame(out, columns=["name", "content"])

    return named.select("slug", "name", "language", "entries", "sources").mapInPandas(run, ARTICLES)


def build_graph(distillates: DataFrame, call: Call | None = None, model: str = "", prompt: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all distillates; with a model, entities it holds for one are merged, and those full names give away."""
    from quern.operators.distill import numbered
    from quern.state import cut

    key = F.xxhash64("digest")
    e = distillates.select(key.alias("k"), F.posexplode("entities").alias("at", "e")).select("e.name", "e.label", "e.props", F.struct("k", "at").alias("ord"))
    merged = cut(graph.merge_nodes(e), "nodes")
    nodes = cut(numbered(merged.withColumn("at", F.col("ord")).drop("ord"), 1, "at", "_b").withColumn("id", F.col("_place").cast("bigint")).select("id", "label", "name", F.array().cast("array<string>").alias("aliases"), "props", F.col("_place").cast("bigint").alias("ord")), "nodes")
    d = distillates.select(key.alias("k"), F.posexplode("edges").alias("at", "e")).select("e.src", "e.rel", "e.dst", F.struct("k", "at").alias("ord"))
    edges = graph.resolve_edges(d, nodes).withColumnRenamed("ord", "at")
    edges = cut(numbered(edges, 1, "at", "_b").select(F.col("_place").cast("bigint").alias("id"), "src", "dst", "rel", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("props"), F.col("_place").cast("bigint").alias("ord")), "edges")
    return (nodes, edges) if call is None else canonicalized(nodes, edges, call, model, prompt)


def canonicalized(nodes: DataFrame, edges: DataFrame, call: Call, model: str = "", prompt: str = "") -> tuple[DataFrame, DataFrame]:
    """A graph whose entities that a model holds for one are merged, and those that full names give away."""
    from quern.state import cut

    made = graph.model_clusters(nodes, call, model, prompt).withColumn("src", F.lit(0))
    full = graph.fullname_clusters(nodes).select("prefLabel", "label", F.array("alias").alias("aliases"), F.array("a", "b").alias("member_ids"), F.lit(1).alias("src"))
    both = made.unionByName(full).filter("size(member_ids) > 0").withColumn("cluster", F.xxhash64("src", "label", "prefLabel", "member_ids"))
    both = cut(both.dropDuplicates(["cluster"]), "clusters")
    rows = both.select("cluster", "prefLabel", "label", "aliases", F.explode("member_ids").alias("member"))
    of = cut(graph.unify_overlapping(rows.select("cluster", "prefLabel", "member")), "of")
    united = rows.join(of, "cluster").groupBy("component").agg(
        F.min("member").alias("ord"), F.first("pref").alias("prefLabel"), F.min("label").alias("label"),
        F.array_sort(F.array_distinct(F.concat(F.collect_set("prefLabel"), F.flatten(F.collect_list("aliases"))))).alias("aliases"), F.array_sort(F.collect_set("member")).alias("member_ids"),
    )
    n, x = graph.apply_clusters(nodes, edges, cut(united, "united"))
    return n.withColumn("ord", F.col("id")), x.withColumn("ord", F.col("id"))


def _unchanged(shown: DataFrame, state: State) -> bool:
    """Whether the state is of just these contents and complete: then nothing is left to do."""
    known = state.read("meta").first()
    if known is None:
        return False
    mark = inventory.corpus_fingerprint(shown.select(text.content_digest(F.col("content")).alias("digest"))).first()["fingerprint"]
    if mark != known["fingerprint"]:
        return False
    articles, clusters = state.read("articles"), state.read("clusters").select("slug")
    due = inventory.article_todo(clusters, clusters.limit(0), articles)
    return due.isEmpty() and not articles.filter("name = '_index.md'").isEmpty()


def compile_corpus(
    raw: DataFrame, state: State, call: Call, model: str = "", domains: list[str] | None = None, langs: list[str] | None = None, prompts: dict[str, str] | None = None, today: str = "",
    canonicalize: bool = False, language: str = "de", jobs: int = 4, with_lint: bool = False, model_index: bool = False,
) -> Report:
    """One run over ``raw(rel, content)``. An unchanged corpus costs no model call and rewrites no article.

    ``language``: of the default instructions, where ``prompts`` gives none. ``with_lint``: a report on all articles, written
    whenever an article or the index changed. ``model_index``: the entry page is written by the model, else it is a list of articles.
    """
    shown = pages.filter_language(pages.filter_domains(pages.parsed(raw), [d.lower() for d in domains] if domains else None), langs, detect=bool(langs)).select("rel", "content")
    if _unchanged(shown, state):
        return Report(pages=state.read("store").count())
    return compile_groups(pages.group_pages(shown, with_content=True), state, call, model, default_prompts(language, prompts), today, canonicalize, jobs, with_lint, model_index)


def compile_groups(groups: DataFrame, state: State, call: Call, model: str, prompts: dict[str, str], today: str = "", canonicalize: bool = False, jobs: int = 4, with_lint: bool = False, model_index: bool = False) -> Report:
    """The steps of a run over page groups, as ``distill.distill_groups`` takes them."""
    from quern.state import cut

    spark, report = groups.sparkSession, Report()
    result = distill.distill_groups(groups, state.read("store"), call, model, prompts["distill"], jobs)
    live = cut(result.distillates, "live")
    report.pages, report.distilled, report.failed = live.count(), result.made.count(), result.failed.count()
    before = state.read("clusters")
    kept, _ = inventory.prune(inventory.members(before), live)
    kept = before.drop("members", "fingerprint").join(kept, "slug")
    clusters = cut(inventory.assign_new(kept, live, call, model, prompts["assign"]), "clusters")
    old = state.read("articles")
    changed = inventory.changed(clusters, before).select("slug")
    todo = cut(inventory.article_todo(clusters, changed, old), "todo")
    written = cut(write_articles(todo, clusters, live, call, model, prompts["article"], today), "written")
    report.changed = sorted(r["name"] for r in written.select("name").collect())  # names of topics
    gone = cut(inventory.orphans(old, clusters), "gone")
    report.removed = sorted(r["name"] for r in gone.collect())
    articles = cut(old.join(written.select("name").union(gone.select("name")), "name", "left_anti").unionByName(written), "articles")
    meta_missing = articles.filter("name = '_index.md'").isEmpty()
    if report.changed or report.removed or meta_missing:
        if model_index:
            index = written_index(articles, clusters, live, call, model, prompts["index"])
        else:
            lines = retrieval.index_lines(articles).orderBy("name").toLocalIterator()
            index = "\n".join(f"- [[{r['name']}]]: {r['first_line']}" for r in lines)
        page = spark.createDataFrame([("_index.md", index)], ARTICLES)
        articles, report.index_built = articles.filter("name <> '_index.md'").unionByName(page), True
        if with_lint:
            found = lint(articles.filter("not startswith(name, '_')"), call, model, prompts["lint"])
            articles = articles.filter("name <> '_lint-report.md'").unionByName(cut(found, "lint"))
    tables = {"store": live, "clusters": clusters, "articles": articles}
    mark = inventory.corpus_fingerprint(live).first()["fingerprint"]
    known = state.read("meta").first()
    if known is None or known["fingerprint"] != mark:
        tables["nodes"], tables["edges"] = build_graph(live, call if canonicalize else None, model, prompts["canonicalize"])
        tables["meta"] = spark.createDataFrame([(mark,)], META)
        report.graph_built = True
    if report.distilled or report.changed or report.removed or report.graph_built or report.index_built:
        state.write(tables)
    return report


def written_index(articles: DataFrame, clusters: DataFrame, distillates: DataFrame, call: Call, model: str = "", prompt: str = "") -> str:
    """The entry page that a model writes from all articles' names and first lines and the language most sources have.

    A call reads a bounded number of lines; the pages that several calls make are put together by further calls, so no prompt holds all lines of
    a large knowledge base, and no process does.
    """
    from quern.operators.reduction import reduced

    named = retrieval.index_lines(articles).join(clusters.select(F.col("slug").alias("name"), F.col("name").alias("title")), "name", "left")
    lines = named.select("name", F.concat(F.lit("  "), "name", F.lit(" → "), F.coalesce("title", "first_line", F.lit(""))).alias("text"))
    found = distillates.filter("language <> ''").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").first()
    head = f"Sprache der Quellen: {found['language']}\n\n" if found else ""

    def combine(texts: list[str], last: bool) -> str:
        return call(f"{prompt}\n\n{head}" + "\n".join(texts), model, 2000 if last else 4000)

    return reduced(lines, combine, "name") or ""


def graph_only(state: State, call: Call | None = None, model: str = "", prompts: dict[str, str] | None = None, language: str = "de") -> tuple[int, int]:
    """The graph of the stored distillates, built anew whatever the last one was; with ``call`` its entities are united. Returns nodes and edges."""
    live = state.read("store")
    nodes, edges = build_graph(live, call, model, default_prompts(language, prompts)["canonicalize"])
    mark = inventory.corpus_fingerprint(live).first()["fingerprint"]
    state.write({"nodes": nodes, "edges": edges, "meta": state.spark.createDataFrame([(mark,)], META)})
    return state.read("nodes").count(), state.read("edges").count()


def canonicalize_only(state: State, call: Call, model: str = "", prompts: dict[str, str] | None = None, language: str = "de") -> tuple[int, int]:
    """The graph there is, with its entities united; pages, topics and articles are not touched. Returns nodes and edges; without a graph nothing is done."""
    nodes, edges = state.read("nodes"), state.read("edges")
    if nodes.isEmpty():
        return 0, 0
    nodes, edges = canonicalized(nodes, edges, call, model, default_prompts(language, prompts)["canonicalize"])
    state.write({"nodes": nodes, "edges": edges})
    return state.read("nodes").count(), state.read("edges").count()


def read_sources(articles: DataFrame) -> DataFrame:
    """(name, sources) that articles name themselves."""
    return articles.select("name", text.article_sources(F.col("content")).alias("sources"))


def lint(articles: DataFrame, call: Call, model: str = "", prompt: str = "", each: int = 3000, most: int = 40_000) -> DataFrame:
    """``_lint-report.md``: a model's view of the first characters of all articles; what it sees is bounded by ``most``."""
    out, size = [], 0
    for r in articles.select("name", F.left("content", F.lit(each)).alias("c")).orderBy("name").toLocalIterator():
        out.append(f"### {r['name']}\n{r['c']}\n\n")
        size += len(out[-1])
        if size >= most:
            break
    return articles.sparkSession.createDataFrame([("_lint-report.md", call(prompt + "".join(out)[:most], model, 4000))], ARTICLES)


def suggested_questions(articles: DataFrame, call: Call, model: str = "", prompt: str = "") -> list[str]:
    """Three or four example questions from the index; none when the model fails."""
    from quern.functions.replies import suggestions

    index = articles.filter("name = '_index.md'").select(F.left("content", F.lit(retrieval.INDEX_CHARS)).alias("c")).first()
    if index is None:
        return []
    try:
        return suggestions(call(f"{prompt}\n\n{index['c']}", model, 300))
    except Exception:  # noqa: BLE001  suggestions are an extra
        return []


def cached_suggestions(state: State, call: Call, model: str = "", prompt: str = "") -> list[str]:
    """``suggested_questions`` of the state's articles, asked for once for each index; an empty answer is not kept."""
    import hashlib

    articles = state.read("articles")
    index = articles.filter("name = '_index.md'").select("content").first()
    if index is None:
        return []
    mark = hashlib.sha256(f"{prompt}\n{index['content']}".encode()).hexdigest()
    kept = state.note("suggestions")
    if kept.get("mark") == mark:
        return kept["questions"]
    found = suggested_questions(articles, call, model, prompt)
    if found:
        state.note("suggestions", {"mark": mark, "questions": found})
    return found
