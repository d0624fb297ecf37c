"""Documents of many pages: which pages are due, which need a model to be read, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text

TEXT_CHARS = 200


def validate_label(label: str) -> str:
    """The label, if it can be a folder name."""
    if not label or "/" in label or "\\" in label or ".." in label:
        raise ValueError(f"not a label: {label!r}")
    return label


def routed(pages: DataFrame, threshold: int = TEXT_CHARS, force: bool = False) -> DataFrame:
    """``route``: ``text`` where the text layer suffices, else ``vision``."""
    enough = F.length(text.strip(F.coalesce(F.col("text"), F.lit("")))) >= threshold
    return pages.withColumn("route", F.when(enough & F.lit(not force), "text").otherwise("vision"))


def budgeted(pages: DataFrame, budget: int | None, order: tuple[str, ...] = ("doc", "page_no")) -> DataFrame:
    """``included``: text pages always, vision pages while the running count of attempts stays within the budget.

    The pages that are rendered are the first ``budget`` by order: found by a top-n, not by a window over all pages.
    """
    if budget is None:
        return pages.withColumn("included", F.lit(True))
    due = pages.filter("route = 'vision'").select(*order).orderBy(*order).limit(budget).withColumn("_due", F.lit(True))
    return pages.join(due, list(order), "left").withColumn("included", (F.col("route") == "text") | F.coalesce("_due", F.lit(False))).drop("_due")


def pending(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, pending): page numbers to read. All of them without an entry, for another hash or another number of pages."""
    m = manifest.select("key", F.col("hash").alias("_h"), F.col("pages_total").alias("_t"), "pages_done")
    d = documents.join(m, "key", "left")
    all_ = F.when(F.col("pages_total") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("pages_total").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    valid = F.coalesce((F.col("_h") == F.col("hash")) & (F.col("_t") == F.col("pages_total")), F.lit(False))
    return d.select("key", F.when(valid, F.array_except(all_, F.col("pages_done").cast("array<bigint>"))).otherwise(all_).alias("pending"))


def without_label(manifest: DataFrame, label: str) -> DataFrame:
    """The manifest less one label's entries."""
    return manifest.filter(~F.col("key").startswith(f"{label}/"))


def report(pages: DataFrame) -> DataFrame:
    """Counters of one ingest: documents, pages, by text, by model, left for want of budget."""
    return pages.agg(
        F.countDistinct("doc").alias("documents"), F.count("*").alias("pages"), F.count_if(F.col("route") == "text").alias("text_pages"),
        F.count_if((F.col("route") == "vision") & F.col("included")).alias("vision_pages"), F.count_if(~F.col("included")).alias("left_out"),
    )


def pdf_pages(files: DataFrame, reader, threshold: int = TEXT_CHARS) -> DataFrame:
    """(doc, page_no, pages_total, text) of ``files(path, content)`` by ``reader(bytes) -> list of page texts``, on executors.

    No PDF library comes with this package; the reader is given. A file that cannot be read has no pages.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    pages = list(reader(content))
                except Exception:  # noqa: BLE001  a broken file must not end the ingest
                    pages = []
                if pages:  # one document at a time
                    yield pd.DataFrame([(str(path), k, len(pages), t) for k, t in enumerate(pages, 1)], columns=["doc", "page_no", "pages_total", "text"])

    return files.filter(F.col("path").rlike(r"(?i)\.pdf$")).select("path", "content").mapInPandas(run, "doc string, page_no bigint, pages_total bigint, text string")


def vision_payload(png) -> F.Column:
    """A page image as a data address."""
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def tail(messages: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each chat."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")
