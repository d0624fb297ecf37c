"""Compiling a folder of files: an index of files tells what changed, and only that is read.

The index is a versioned table with a row for each page: its file's path, size and time, and what a run needs of the page (path, digest, domain, language).
A run lists the files (no text is read), and ends there if the listing is that of the last run. Else new and changed files are read and
indexed, and of all others only those whose content the store does not hold.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import html, text
from quern.operators import pages
from quern.operators.inventory import LANES, multiset_sums
from quern.plans.compile import Call, Report, State, compile_groups
from quern.plans.prompts import prompts as default_prompts
from quern.state import cut

INDEX = {"files": "path string, size bigint, modified timestamp, rel string, digest string, domain string, language string, guessed string"}
FILE = ["path", "size", "modified"]
#: Up to so many files are read by name; more are read as their folder and joined.
BY_NAME = 10_000


def _path() -> F.Column:
    """A file's path as it is written, from its escaped form."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


class Files:
    """Raw pages in files: Markdown, each file a page, or Parquet of ``rel, content``."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "markdown"):
        if kind not in ("markdown", "parquet"):
            raise ValueError(f"neither markdown nor parquet: {kind}")
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind

    def listing(self) -> DataFrame:
        """(path, size, modified) of all files, without reading them."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md" if self.kind == "markdown" else "*.parquet").load(self.folder)
        return found.select(_path().alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))

    def pages(self, paths: DataFrame) -> DataFrame:
        """(path, rel, content) of the files ``paths(path)``."""
        names = [r["path"] for r in paths.select("path").limit(BY_NAME + 1).collect()]
        whole = len(names) > BY_NAME or any(c in n for n in names for c in "{}[]*?\\")
        if not names:
            return self.spark.createDataFrame([], "path string, rel string, content string")
        reader = self.spark.read.option("recursiveFileLookup", True)
        if self.kind == "parquet":
            found = reader.schema("rel string, content string").option("pathGlobFilter", "*.parquet").parquet(*([self.folder] if whole else names)).select(_path().alias("path"), "rel", "content")
        else:
            found = reader.text([self.folder] if whole else names, wholetext=True, pathGlobFilter="*.md").select(_path().alias("path"), F.col("value").alias("content"))
            root = self.folder.rsplit("://", 1)[-1].removeprefix("file:") + "/"
            found = found.select("path", F.col("path").substr(F.instr("path", root) + len(root), F.length("path")).alias("rel"), "content")
        return found.join(paths.select("path"), "path", "left_semi") if whole else found


def _mark(listing: DataFrame) -> str:
    """A multiset hash of a listing: one small row comes to the driver."""
    row = multiset_sums(listing.select(F.concat_ws("\n", "path", "size", F.col("modified").cast("double").cast("string")).alias("v")), "v").first()
    return ":".join(str(row[c]) for c in ("n", *(f"s{i}" for i in range(LANES))))


def indexed(found: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index rows of pages ``path, rel, content`` in the files ``fresh``; a file without pages has one row without page."""
    p = found.select("path", "rel", "content", text.content_digest(F.col("content")).alias("digest"), text.page_domain(F.col("content")).alias("domain"), text.page_language(F.col("content")).alias("language"))
    known, unknown = p.filter("language is not null").withColumn("guessed", F.lit(None).cast("string")), p.filter("language is null")
    both = known.unionByName(unknown.withColumn("guessed", html.guessed_language(text.body(F.col("content"))))).drop("content")
    return fresh.join(both, "path", "left").select(*FILE, "rel", "digest", "domain", "language", "guessed")


def compile_folder(files: Files, state: State, call: Call, model: str = "", domains: list[str] | None = None, langs: list[str] | None = None, prompts: dict[str, str] | None = None, today: str = "", canonicalize: bool = False, language: str = "de", jobs: int = 4, with_lint: bool = False, model_index: bool = False) -> Report:
    """``compile.compile_corpus`` over files. A run over files that did not change lists them and reads nothing else.

    A file counts as changed when its size or time differs. What a file names twice, or two files do, are pages of the same path, each with its own
    content. A run after one with failed calls is not passed over: what failed is read and tried again.
    """
    spark = files.spark
    index = State(spark, f"{state.root}/_files", INDEX)
    settings = hashlib.sha256(json.dumps([files.folder, files.kind, sorted(domains or []), sorted(langs or []), canonicalize]).encode()).hexdigest()
    listing = files.listing()
    mark, note = _mark(listing), index.note("run")
    if note.get("mark") == mark and note.get("settings") == settings and note.get("version") == state.version() and note.get("complete"):
        return Report(pages=note["pages"])
    listing = cut(listing, "listing")
    old = index.read("files")
    fresh = cut(listing.join(old.select(*FILE).distinct(), FILE, "left_anti"), "fresh")
    now = cut(old.join(listing, FILE, "left_semi").unionByName(indexed(files.pages(fresh), fresh)), "index")
    shown = pages.filter_domains(now.filter("rel is not null"), [d.lower() for d in domains] if domains else None)
    if langs:
        said = F.coalesce("language", "guessed")
        shown = shown.filter(said.isNull() | said.isin([x.lower() for x in langs]))
    first = F.min(F.struct("rel", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("language", F.lit("")).alias("language"), "path"))
    groups = shown.groupBy("digest").agg(F.array_sort(F.collect_list("rel")).alias("sources"), first.alias("first")).select("digest", "sources", "first.domain", "first.language", "first.rel", "first.path")
    groups = cut(groups, "groups")
    due = cut(groups.join(state.read("store").select("digest"), "digest", "left_anti").select("digest", "rel", "path"), "due")
    # a file that changed since it was listed gives another digest, and waits for the next run
    read = files.pages(due.select("path").distinct()).withColumn("digest", text.content_digest(F.col("content"))).join(due, ["path", "rel", "digest"], "left_semi")
    contents = read.groupBy("digest").agg(F.min("content").alias("content"))
    report = compile_groups(groups.select("digest", "sources", "domain", "language").join(contents, "digest", "left"), state, call, model, default_prompts(language, prompts), today, canonicalize, jobs, with_lint, model_index)
    index.write({"files": now})
    missing = due.join(state.read("store").select("digest"), "digest", "left_anti").isEmpty()
    slugs, written = state.read("clusters").select("slug"), state.read("articles").select(F.regexp_replace("name", r"\.md$", "").alias("slug"))
    complete = missing and slugs.join(written, "slug", "left_anti").isEmpty()
    index.note("run", {"mark": mark, "settings": settings, "version": state.version(), "complete": complete, "pages": report.pages})
    return report
