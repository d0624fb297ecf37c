"""PDF pages as a Spark data source: partitions are ranges of pages, so one large file is read by several tasks.

    spark.dataSource.register(PdfPages)
    spark.read.format("pdf_pages").option("reader", "my_module:open_pdf").load("file:///data/manuals")

No PDF library comes with this package. ``reader`` names a callable ``(file, password) -> document``; ``file`` can be read and searched, so a
library need not load all of it. A document has ``len(document)`` pages, a ``title`` (may be empty), ``text(page)`` and ``png(page, dpi)``, pages from 0.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

#: Resolution of rendered pages; a text layer with fewer characters does not count.
DPI, TEXT_CHARS = 200, 200
#: Bytes of a file for each task.
SLOT_BYTES = 16 << 20
PAGE = "rel string, title string, page_no bigint, pages_total bigint, text string, png binary, error string"


def file_system(path: str):
    """The file system of an address and the path within it; plain paths are local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), str(PurePosixPath(path))


def find_pdfs(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """(root, files as (path below the root, bytes) in order, number of other files): all levels, ``.pdf`` in any case.

    A single file is found whatever it is called; its folder is the root. A path that does not exist is an error.
    """
    from pyarrow import fs

    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return str(PurePosixPath(info.path).parent), [(PurePosixPath(info.path).name, info.size)], 0
    root = info.path.rstrip("/")
    files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    pdfs = sorted((f.path.removeprefix(root).lstrip("/"), f.size) for f in files if f.path.lower().endswith(".pdf"))
    return root, pdfs, len(files) - len(pdfs)


def opener(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def fallback_title(rel: str) -> str:
    return PurePosixPath(rel).stem


def page_rows(document, rel: str, numbers: range, render: str, dpi: int, threshold: int) -> Iterator[tuple]:
    """Rows of PAGE for some pages; a page that cannot be read has its error in place of a text, the others are not affected."""
    title = (getattr(document, "title", None) or "").strip() or fallback_title(rel)
    for k in numbers:
        try:
            text = document.text(k) or ""
            image = document.png(k, dpi) if render == "always" or (render == "auto" and len(text.strip()) < threshold) else None
            yield rel, title, k + 1, len(document), text, image, None
        except Exception as e:  # noqa: BLE001  one page must not end the others
            yield rel, title, k + 1, len(document), None, None, f"{type(e).__name__}: {e}"


@dataclass
class Slot(InputPartition):
    """A share of a file's pages."""

    root: str
    rel: str
    slot: int
    slots: int


class PdfPages(DataSource):
    """Format ``pdf_pages``.

    Options: path (file or folder), reader, password, render (``never``, ``auto``: pages without enough text layer, ``always``), dpi, threshold,
    slotBytes. How many pages a file has is found by the tasks, not by the driver: a file of n slots gives its s-th n-th of pages to slot s. A file that
    cannot be opened (broken, or another password) is one row with its error and no page number.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        if not {"path", "reader"} <= set(self.options):
            raise ValueError("the options path and reader are needed")
        if self.options.get("render", "auto") not in ("never", "auto", "always"):
            raise ValueError("render is never, auto or always")

    def partitions(self) -> list[Slot]:
        root, files, _ = find_pdfs(self.options["path"])
        size = int(self.options.get("slotbytes", SLOT_BYTES))
        out = []
        for rel, n in files:
            slots = max(1, -(-n // size))
            out += [Slot(root, rel, s, slots) for s in range(slots)]
        return out

    def read(self, part: Slot) -> Iterator[tuple]:
        o = self.options
        try:
            system, _ = file_system(o["path"])
            with system.open_input_file(f"{part.root}/{part.rel}") as f:
                document = opener(o["reader"])(f, o.get("password"))
                n = len(document)
                numbers = range(part.slot * n // part.slots, (part.slot + 1) * n // part.slots)
                yield from page_rows(document, part.rel, numbers, o.get("render", "auto"), int(o.get("dpi", DPI)), int(o.get("threshold", TEXT_CHARS)))
        except Exception as e:  # noqa: BLE001  a broken file must not end the ingest; it is told once
            if part.slot == 0:
                yield part.rel, fallback_title(part.rel), None, None, None, None, f"{type(e).__name__}: {e}"


@udtf(returnType="page_no bigint, pages_total bigint, title string, text string, error string")
class PdfTable:
    """Table function (content, reader, password): the pages of a PDF that is a value; for files that other Spark sources read."""

    def eval(self, content: bytes, reader: str, password: str):
        import io

        if content is None:
            return
        try:
            document = opener(reader)(io.BytesIO(bytes(content)), password)
            for _, title, k, n, text, _, error in page_rows(document, "", range(len(document)), "never", DPI, TEXT_CHARS):
                yield k, n, title, text, error
        except Exception as e:  # noqa: BLE001
            yield None, None, None, None, f"{type(e).__name__}: {e}"


def register(spark: SparkSession) -> None:
    """The format ``pdf_pages`` and the table function ``pdf_table``."""
    spark.dataSource.register(PdfPages)
    spark.udtf.register("pdf_table", PdfTable)


def read_pdfs(spark: SparkSession, path: str, reader: str, password: str | None = None, render: str = "auto", slot_bytes: int = SLOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): pages as ``plans.ingest.ingest_documents`` takes them, each with its file's SHA-256; (rel, page_no, error) of what failed.

    Digests come from one pass of Spark's own reader over the files.
    """
    register(spark)
    source = spark.read.format("pdf_pages").option("reader", reader).option("render", render).option("slotBytes", slot_bytes)
    rows = (source.option("password", password) if password else source).load(path)
    root, _, _ = find_pdfs(path)
    above = root.rstrip("/") + "/"
    one = path.rsplit("/", 1)[-1]  # a single file counts whatever it is called
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.lower("path").endswith(".pdf") | F.col("path").endswith("/" + one))
    marks = files.select(F.col("path").substr(F.instr("path", above) + len(above), F.length("path")).alias("rel"), F.sha2("content", 256).alias("hash"))
    good = rows.filter("error is null").join(marks, "rel")
    return good.select("rel", "title", "hash", "pages_total", "page_no", "text", "png"), rows.filter("error is not null").select("rel", "page_no", "error")
