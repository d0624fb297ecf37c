"""Documents into raw pages: what is due, text layers first, a model for the rest within a budget; resumable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import documents, pages
from quern.state import cut

#: Fixed value: what a model answers for an empty page.
BLANK = "(leere Seite)"
MANIFEST = "key string, hash string, pages_total bigint, pages_done array<bigint>"


@dataclass
class Ingest:
    """raw: (rel, content) of new pages; manifest: all entries after the run; errors: (key, page_no, error); report: counters."""

    raw: DataFrame
    manifest: DataFrame
    errors: DataFrame
    report: dict


def ingest_documents(found: DataFrame, manifest: DataFrame, label: str, call: Callable[[bytes], str] | None, budget: int | None = None, threshold: int = documents.TEXT_CHARS, force: bool = False, fresh: bool = False, jobs: int = 4, day: str = "") -> Ingest:
    """One run over ``found(rel, title, hash, pages_total, page_no, text, png)``, the pages of documents under a label.

    Pages done before under the same hash and number of pages are left out. A text layer that suffices is taken as it is;
    other pages go to ``call(png)``, as many as the budget allows, attempts counted. Blank pages are done without being
    written; failed and empty answers stay due. The manifest names exactly the pages that were written or blank.
    """
    documents.validate_label(label)
    if fresh:
        manifest = documents.without_label(manifest, label)
    f = found.withColumn("key", F.concat(F.lit(f"{label}/"), "rel"))
    docs = f.groupBy("key").agg(F.first("hash").alias("hash"), F.max("pages_total").cast("bigint").alias("pages_total"))
    due = documents.pending(docs, manifest).select("key", F.explode("pending").alias("page_no"))
    work = f.join(due, ["key", "page_no"])
    routed = documents.budgeted(documents.routed(work, threshold, force), budget if call else 0, ("key", "page_no"))
    routed = cut(routed, "routed")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        def one(png):
            try:
                answer = (call(bytes(png)) or "").strip()
                return (None, "empty answer") if not answer else (answer, None)
            except Exception as e:  # noqa: BLE001  one page must not end the run
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(max(1, jobs)) as pool:
            for frame in frames:
                got = list(pool.map(one, frame["png"]))
                yield pd.DataFrame([(k, int(n), m, e) for k, n, (m, e) in zip(frame["key"], frame["page_no"], got, strict=True)], columns=["key", "page_no", "markdown", "error"])

    seen = routed.filter("route = 'vision' and included").select("key", "page_no", "png")
    answers = cut(seen.mapInPandas(run, "key string, page_no bigint, markdown string, error string"), "answers")
    texts = routed.filter("route = 'text'").select("key", "page_no", text.strip(F.col("text")).alias("markdown"), F.lit(None).cast("string").alias("error"))
    done = texts.unionByName(answers).filter("markdown is not null")
    about = f.select("key", "rel", "title", "page_no", "pages_total")
    written = done.filter(text.strip(F.col("markdown")) != BLANK).join(about, ["key", "page_no"])
    path = F.concat(F.lit(f"{label}/"), pages.page_file(pages.document_slug(F.col("rel")), F.col("page_no"), F.col("pages_total")))
    head = text.document_metadata(F.coalesce("title", "rel"), F.col("rel"), F.col("page_no"), F.lit(label), F.lit(day), F.lit(None).cast("string"))
    raw = cut(written.select(path.alias("rel"), F.concat(head, "markdown", F.lit("\n")).alias("content")), "raw")
    now = done.groupBy("key").agg(F.collect_set("page_no").alias("new"))
    old = manifest.select("key", F.col("hash").alias("_h"), F.col("pages_total").alias("_t"), "pages_done")
    same = (F.col("_h") == F.col("hash")) & (F.col("_t") == F.col("pages_total"))
    none = F.array().cast("array<bigint>")
    entries = docs.join(now, "key", "left").join(old, "key", "left").select("key", "hash", "pages_total", F.array_sort(F.array_union(F.coalesce(F.when(same, F.col("pages_done").cast("array<bigint>")), none), F.coalesce("new", none))).alias("pages_done"))
    merged = cut(manifest.join(docs.select("key"), "key", "left_anti").select("key", "hash", F.col("pages_total").cast("bigint").alias("pages_total"), F.col("pages_done").cast("array<bigint>").alias("pages_done")).unionByName(entries), "manifest")
    counts = documents.report(routed.withColumn("doc", F.col("key"))).first().asDict()
    errors = answers.filter("error is not null").select("key", "page_no", "error")
    return Ingest(raw, merged, errors, counts | {"written": raw.count(), "failed": errors.count()})


def ingest_folder(spark, path: str, data: str, label: str, reader: str, call: Callable[[bytes], str] | None = None, password: str | None = None, budget: int | None = None, threshold: int = documents.TEXT_CHARS, force: bool = False, fresh: bool = False, jobs: int = 4, day: str = "") -> dict:
    """All PDFs below ``path`` as Markdown pages below ``data``/raw/``label``; returns the counters, with ``errors``: (file, page, error).

    What was done before is known from the manifest, a versioned table below ``data``/documents; the pages are written before the manifest that
    names them, so a run that dies does them again. ``errors`` are at most a hundred, for people.
    """
    from quern.plans.compile import State
    from quern.sources import files, pdf

    documents.validate_label(label)
    _, found, other = pdf.find_pdfs(path)
    if not found:
        raise FileNotFoundError(f"no PDF files: {path}")
    read, failed = pdf.read_pdfs(spark, path, reader, password, "always" if force else "auto" if call else "never")
    state = State(spark, f"{data}/documents")
    v = state.version()
    manifest = spark.read.schema(MANIFEST).parquet(f"{state.root}/v={v}/manifest") if v is not None else spark.createDataFrame([], MANIFEST)
    done = ingest_documents(cut(read, "pages"), manifest, label, call, budget, threshold, force, fresh, jobs, day)
    files.write_markdown(done.raw, f"{data}/raw")
    new = 0 if v is None else v + 1
    done.manifest.write.mode("overwrite").parquet(f"{state.root}/v={new}/manifest")
    state.complete(new)
    errors = failed.select("rel", "page_no", "error").unionByName(done.errors.select(F.col("key").alias("rel"), "page_no", "error"))
    return done.report | {"other_files": other, "errors": [tuple(r) for r in errors.orderBy("rel", "page_no").limit(100).collect()]}
