"""Files in and out: Markdown folders, bookmarks, JSON state of other tools, exports."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls


def read_markdown(spark: SparkSession, folder: str, recursive: bool = True, key: str = "rel") -> DataFrame:
    """(rel, content) of all ``.md`` files, each as one value; ``rel`` is the path below the folder."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.md")
    root = F.lit(folder.rstrip("/").rsplit("://", 1)[-1].removeprefix("file:"))
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rel = F.expr("substring(path, instr(path, root) + length(root) + 1)")
    return raw.select(F.col("value").alias("content"), path.alias("path"), root.alias("root")).select(rel.alias(key), "content")


def read_wiki(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the articles of one wiki folder."""
    return read_markdown(spark, folder, recursive=False, key="name")


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(url, ord) of a bookmarks export."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(urls.bookmark_links(F.col("value"))).alias("ord", "url")).select("url", "ord")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, hash) of all files below a folder, to be split by ``operators.documents.pdf_pages``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content", F.sha2("content", 256).alias("hash"))


def graph_folders(lang: str | None = None, namespace: str | None = None) -> list[str]:
    """Names a graph's folder may have, best first. A namespace never falls back to the common graph."""
    base = f"graph-{namespace}" if namespace else "graph"
    return [f"{base}-{lang.strip().lower()}", base] if lang else [base]


NODES = "id bigint, label string, name string, aliases array<string>, props map<string,string>"
EDGES = "id bigint, src bigint, dst bigint, rel string, props map<string,string>"


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the class of paths."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _graph_version(spark: SparkSession, folder: str) -> int | None:
    """The highest version below a graph's folder that is complete: its ``meta.json`` is there."""
    fs, path = _hadoop(spark, folder)
    if not fs.exists(path(folder)):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return max((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(path(f"{folder}/{n}/meta.json"))), default=None)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, meta: dict, keep: int = 2) -> tuple[int, int]:
    """A graph as JSON: nodes, edges and ``meta.json`` with its name, fingerprint and so on; returns the numbers of nodes and edges.

    ``<folder>/v=N/nodes.json`` and ``edges.json`` are folders of JSON lines, written by executors. ``meta.json`` is put in place last, in one step,
    and is what makes the version count: readers see the three together or the graph before. All but the last ``keep`` versions are deleted.
    """
    spark = nodes.sparkSession
    fs, path = _hadoop(spark, folder)
    v = _graph_version(spark, folder)
    at = f"{folder}/v={0 if v is None else v + 1}"
    plain = lambda df, ddl: df.select(*[c.split(" ")[0] for c in ddl.split(", ")])
    plain(nodes, NODES).write.mode("overwrite").option("ignoreNullFields", False).json(f"{at}/nodes.json")
    plain(edges, EDGES).write.mode("overwrite").option("ignoreNullFields", False).json(f"{at}/edges.json")
    n = spark.read.schema(NODES).json(f"{at}/nodes.json").count()
    m = spark.read.schema(EDGES).json(f"{at}/edges.json").count()
    out = fs.create(path(f"{at}/meta.json.tmp"), True)
    out.write(bytearray(json.dumps({"name": "knowledge graph", "nodes": n, "edges": m} | meta, ensure_ascii=False, indent=2).encode()))
    out.close()
    if not fs.rename(path(f"{at}/meta.json.tmp"), path(f"{at}/meta.json")):
        raise FileExistsError(f"another run wrote {at}")
    for old in range(max(0, (0 if v is None else v + 1) - keep + 1)):
        fs.delete(path(f"{folder}/v={old}/meta.json"), False)
        fs.delete(path(f"{folder}/v={old}"), True)
    return n, m


def read_graph(spark: SparkSession, data: str, lang: str | None = None, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the first folder that has a graph: what ``write_graph`` wrote, or two files of one JSON array each; empty tables without one."""
    for name in graph_folders(lang, namespace):
        v = _graph_version(spark, f"{data}/{name}")
        at, whole = (f"{data}/{name}", True) if v is None else (f"{data}/{name}/v={v}", False)
        try:
            nodes = spark.read.schema(NODES).json(f"{at}/nodes.json", multiLine=whole)
            edges = spark.read.schema(EDGES).json(f"{at}/edges.json", multiLine=whole)
        except Exception as err:  # noqa: BLE001  only a missing path leads on to the next folder
            if "PATH_NOT_FOUND" in str(err):
                continue
            raise
        return nodes.withColumn("ord", F.col("id")), edges.withColumn("ord", F.col("id"))
    return spark.createDataFrame([], NODES + ", ord bigint"), spark.createDataFrame([], EDGES + ", ord bigint")


def read_graph_meta(spark: SparkSession, data: str, lang: str | None = None, namespace: str | None = None) -> dict:
    """``meta.json`` of the first folder that has one; empty without."""
    for name in graph_folders(lang, namespace):
        v = _graph_version(spark, f"{data}/{name}")
        at = f"{data}/{name}/meta.json" if v is None else f"{data}/{name}/v={v}/meta.json"
        fs, path = _hadoop(spark, at)
        if fs.exists(path(at)):
            stream = fs.open(path(at))
            raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return json.loads(raw)
    return {}


def delete_markdown(spark: SparkSession, folder: str, domain: str) -> int:
    """Delete all raw pages of a domain below a folder, then folders that are empty; returns how many files went, 0 if the domain has none.

    Executors read the pages' metadata blocks and delete the files; the folder is one that they share.
    """
    from quern.functions import text
    from quern.sources.pdf import file_system

    def run(frames):
        import pandas as pd

        system, root = file_system(folder)
        for frame in frames:
            for rel in frame["rel"]:
                system.delete_file(f"{root}/{rel}")
            yield pd.DataFrame({"n": [len(frame)]})

    due = read_markdown(spark, folder).filter(text.page_domain(F.col("content")) == domain).select("rel")
    from quern.state import cut

    gone = cut(due, "delete").mapInPandas(run, "n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0
    if gone:
        _prune(*file_system(folder))
    return gone


def _prune(system, folder: str) -> bool:
    """Delete folders without any file below; whether this one is empty now (it stays itself)."""
    from pyarrow import fs

    empty = True
    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.type == fs.FileType.Directory and _prune(system, f.path):
            system.delete_dir(f.path)
        else:
            empty = False
    return empty


def load_json(path: str, default, strict: bool = False):
    """State of other tools: missing or broken files give the default; ``strict`` lets broken ones fail."""
    if not os.path.exists(path):
        return default
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError:
        if strict:
            raise
        return default


def load_inventory(path: str) -> dict:
    """An inventory of schema 1; anything else is an empty one."""
    data = load_json(path, None)
    return data if isinstance(data, dict) and data.get("schema") == 1 else {"schema": 1, "clusters": []}


def save_json(path: str, value) -> None:
    """Written beside the target and moved onto it: readers see the old or the new file, never a torn one."""
    temp = f"{path}.tmp"
    Path(temp).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    os.replace(temp, path)


def export_name(now: datetime) -> str:
    return f"export-{now:%Y-%m-%d-%H%M}.zip"


def write_export(data: str, target: str, chats: bool = True, top: str = "data") -> tuple[int, int]:
    """A ZIP of a data folder, (files, bytes), all below ``top`` in the archive; refused inside the folder itself.

    Written under a name of its own beside the target and moved onto it when complete; nothing is left behind by a run that fails, and two runs do
    not meet.
    """
    root, out = Path(data).resolve(), Path(target).resolve()
    if not root.is_dir():
        raise FileNotFoundError(f"no data folder: {data}")
    if any(p.exists() and p.samefile(root) for p in (out, *out.parents)):
        raise ValueError("the export would contain itself")
    out.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(prefix=f".{out.name}.", suffix=".tmp", dir=out.parent)
    n = size = 0
    try:
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(p for p in root.rglob("*") if p.is_file()):
                rel = path.relative_to(root).as_posix()
                if path.name != ".DS_Store" and not path.name.endswith(".tmp") and (chats or not rel.startswith("chats/")):
                    z.write(path, f"{top}/{rel}")
                    n, size = n + 1, size + path.stat().st_size
        os.replace(temp, out)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    return n, size


def wiki_languages(data: str, prefix: str | None = "wiki") -> list[dict]:
    """Wiki folders that hold Markdown: the base one and ``<prefix>-<lang>``."""
    root = Path(data)
    if prefix is None or not root.exists():
        return []
    out = []
    for d in sorted(p for p in root.iterdir() if p.is_dir() and any(p.glob("*.md"))):
        if d.name == prefix or d.name.startswith(prefix + "-"):
            out.append({"lang": d.name[len(prefix) + 1 :], "dir": d.name, "default": d.name == prefix})
    return out


def beside(data: str, wiki: str, kind: str) -> str:
    """The folder of a kind (``graph``, ``distill``, ``_inventory``) that belongs to a wiki folder: it ends as that one does.

    ``wiki-de`` has ``distill-de`` beside it, ``wiki`` has ``distill``; a folder that does not begin with ``wiki`` has those without an ending.
    """
    name = Path(wiki).name
    return f"{data.rstrip('/')}/{kind}{name.removeprefix('wiki') if name.startswith('wiki') else ''}"


def wiki_folder(data: str, lang: str | None = None, prefix: str = "wiki") -> str:
    """The folder of a language, or the base folder where it has none."""
    own = Path(data, f"{prefix}-{lang.strip().lower()}") if lang else None
    return str(own if own and own.exists() else Path(data, prefix))


def write_markdown(pages: DataFrame, folder: str, key: str = "rel") -> int:
    """Pages as files below a folder, written by executors; returns how many.

    The folder is one that driver and executors share, of any file system. A file is written under another name and moved onto its own, so
    readers see the old or the new one, and a task that runs twice leaves one. A path that leads out of the folder is an error.
    """
    from quern.sources.pdf import file_system

    def run(frames):
        import uuid
        from posixpath import dirname, normpath

        import pandas as pd

        system, root = file_system(folder)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                path = normpath(f"{root}/{name}")
                if not path.startswith(root.rstrip("/") + "/"):
                    raise ValueError(f"outside of the folder: {name!r}")
                system.create_dir(dirname(path), recursive=True)
                temp = f"{path}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temp) as f:
                    f.write((content or "").encode())
                system.move(temp, path)
            yield pd.DataFrame({"n": [len(frame)]})

    found = pages.select(F.col(key).alias("name"), "content").mapInPandas(run, "n bigint").agg(F.sum("n").alias("n")).first()["n"]
    return found or 0
