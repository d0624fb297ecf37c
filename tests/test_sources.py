"""The graph as JSON, and raw pages that can be deleted by domain."""

from __future__ import annotations

import json

import pytest

from quern.sources import files
from quern.sources.corpus import Corpus


def content(domain, body):
    return f'---\ndomain: "{domain}"\n---\n\n{body}\n'


def graph(spark, n):
    nodes = spark.createDataFrame([(i, "Begriff", f"Näme {i}", [f"alias {i}"], {"description": "x\ny"}, i) for i in range(n)], files.NODES + ", ord bigint")
    edges = spark.createDataFrame([(i, i, (i + 1) % n, "USES", {}, i) for i in range(n)], files.EDGES + ", ord bigint")
    return nodes, edges


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_graph_comes_back_as_it_was_written(spark, tmp_path):
    nodes, edges = graph(spark, 30)
    assert files.write_graph(nodes, edges, f"{tmp_path}/graph", {"fingerprint": "abc", "compiled": "2026-01-01 10:00"}) == (30, 30)
    n, e = files.read_graph(spark, str(tmp_path))
    assert same(n, nodes) and same(e, edges)
    assert files.read_graph_meta(spark, str(tmp_path)) == {"name": "knowledge graph", "nodes": 30, "edges": 30, "fingerprint": "abc", "compiled": "2026-01-01 10:00"}
    # the graph of another language falls back to the common one, that of a namespace never does
    assert files.read_graph(spark, str(tmp_path), lang="EN")[0].count() == 30 and files.read_graph(spark, str(tmp_path), namespace="x")[0].count() == 0
    assert files.read_graph_meta(spark, str(tmp_path), namespace="x") == {}


def test_a_run_that_dies_leaves_the_graph_before(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/graph"
    files.write_graph(*graph(spark, 3), folder, {"fingerprint": "old"})
    with monkeypatch.context() as m:
        m.setattr(files.json, "dumps", lambda *a, **k: 1 / 0)  # after both tables, before the last file
        with pytest.raises(ZeroDivisionError):
            files.write_graph(*graph(spark, 5), folder, {"fingerprint": "new"})
    assert files.read_graph(spark, str(tmp_path))[0].count() == 3 and files.read_graph_meta(spark, str(tmp_path))["fingerprint"] == "old"
    for k in range(3):
        files.write_graph(*graph(spark, 6 + k), folder, {"fingerprint": f"new {k}"})
    assert files.read_graph(spark, str(tmp_path))[0].count() == 8 and sorted(p.name for p in (tmp_path / "graph").iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]


def test_plain_files_of_other_tools_are_read(spark, tmp_path):
    (tmp_path / "graph").mkdir()
    (tmp_path / "graph" / "nodes.json").write_text(json.dumps([{"id": 0, "name": "A", "label": "B", "props": {}}], indent=2))
    (tmp_path / "graph" / "edges.json").write_text("[]")
    (tmp_path / "graph" / "meta.json").write_text('{"fingerprint": "f"}')
    assert files.read_graph(spark, str(tmp_path))[0].first()["name"] == "A" and files.read_graph_meta(spark, str(tmp_path)) == {"fingerprint": "f"}


def test_compile_writes_a_graph_that_is_read(spark, tmp_path, capsys):
    from quern import cli
    from quern.plans.compile import State

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.md").write_text(content("d", "Eine Seite über Dinge und Sachen mit Haus und Garten."))
    cli.main(["compile", "--raw", f"{tmp_path}/raw", "--state", f"{tmp_path}/state", "--graph-dir", f"{tmp_path}/graph"])
    state = State(spark, f"{tmp_path}/state")
    assert files.read_graph_meta(spark, str(tmp_path))["fingerprint"] == state.read("meta").first()["fingerprint"]
    assert same(files.read_graph(spark, str(tmp_path))[0].drop("ord"), state.read("nodes").drop("ord")) and "graph written" in capsys.readouterr().out
    cli.main(["compile", "--raw", f"{tmp_path}/raw", "--state", f"{tmp_path}/state", "--graph-only"])
    assert "nodes, edges:" in capsys.readouterr().out


def test_files_of_a_domain_are_deleted_with_their_folders(spark, tmp_path):
    for name, domain in (("a/x/1.md", "d1"), ("a/x/2.md", "d1"), ("a/3.md", "d2"), ("b/ü 4.md", "d1")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content(domain, "text"))
    assert files.delete_markdown(spark, str(tmp_path), "none") == 0
    assert files.delete_markdown(spark, str(tmp_path), "d1") == 3
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*")) == ["a", "a/3.md"]


def parts(tmp_path):
    return {p.relative_to(tmp_path).as_posix(): p.stat().st_mtime_ns for p in (tmp_path / "pages").rglob("*.parquet")}


def pages(spark, rows):
    return spark.createDataFrame([(rel, content(d, body)) for rel, d, body in rows], "rel string, content string")


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path), buckets=8)
    corpus.upsert(pages(spark, [(f"{k}.md", f"d{k % 5}", f"body {k}") for k in range(40)]))
    corpus.upsert(pages(spark, [("only.md", "rare", "x"), ("1.md", "d1", "new body"), ("1.md", "d1", "a new body")]))
    rows = {r["rel"]: r for r in corpus.read().collect()}
    assert len(rows) == 41 and rows["1.md"]["content"] == content("d1", "new body")
    before = parts(tmp_path)
    assert corpus.delete_domain("nothing") == 0 and parts(tmp_path) == before and corpus.tombstones().isEmpty()
    assert corpus.delete_domain("rare") == 1
    after = parts(tmp_path)
    assert len(set(before) - set(after)) == 1 and {r["rel"] for r in corpus.read().collect()} == {f"{k}.md" for k in range(40)}
    assert corpus.delete_domain("d3") == 8 and corpus.read().count() == 32


def test_a_deletion_that_died_hides_at_once_and_is_finished(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, str(tmp_path), buckets=4)
    corpus.upsert(pages(spark, [(f"{k}.md", f"d{k % 2}", "b") for k in range(10)]))
    with monkeypatch.context() as m:
        m.setattr(corpus, "_rewrite", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            corpus.delete_domain("d1")
    assert corpus.read().count() == 5 and corpus._all().count() == 10
    corpus.upsert(pages(spark, [("1.md", "d1", "back again")]))  # a domain may come back
    assert corpus._all().count() == 6 and corpus.read().count() == 6


def test_a_partition_that_keeps_nothing_is_gone(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path), buckets=2)
    corpus.upsert(pages(spark, [("a.md", "d", "b")]))
    assert corpus.delete_domain("d") == 1 and corpus.read().isEmpty() and not list((tmp_path / "pages").glob("bucket=*"))


@pytest.mark.parametrize(("wiki", "want"), [("wiki", "distill"), ("x/wiki-de", "distill-de"), ("wiki-ABC/", "distill-ABC"), ("other", "distill"), ("mywiki-de", "distill")])
def test_folders_beside_a_wiki(wiki, want):
    assert files.beside("data/", wiki, "distill") == f"data/{want}"
