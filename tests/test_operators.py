"""Operators on the small inputs that define them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.functions.text import fingerprint
from quern.operators import crawl, distill, documents, graph, inventory, retrieval
from quern.operators.components import components
from quern.sources import files, robots, sitemap

PROPS = "map<string,string>"


def nodes_of(spark, rows):
    """(id, label, name, aliases, props)"""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"id bigint, label string, name string, aliases array<string>, props {PROPS}, ord bigint")


def edges_of(spark, rows):
    """(src, dst, rel, props)"""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"src bigint, dst bigint, rel string, props {PROPS}, ord bigint")


def clusters_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, prefLabel string, label string, aliases array<string>, member_ids array<bigint>")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14), (20, 20), (30, 31), (31, 30), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 30: 30, 31: 30}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_apply_clusters(spark):
    nodes = nodes_of(spark, [(12, "Ort", "Frankfurt am Main", [], {"source": "domain", "a": "1"}), (47, "Ort", "Frankfurt", [], {"source": "local", "a": "2"}), (103, "Ort", "FFM", [], {}), (5, "Firma", "X", ["ex"], {"source": "domain"})])
    edges = edges_of(spark, [(5, 12, "IN", {"source": "domain"}), (5, 47, "IN", {"source": "local", "k": "v"}), (12, 47, "IN", {}), (5, 999, "IN", {}), (103, 5, "HAS", {})])
    n, e = graph.apply_clusters(nodes, edges, clusters_of(spark, [("Frankfurt am Main", "Ort", ["FFM", "FFM", "Frankfurt am Main", ""], [12, 47, 103, 777]), ("", "Ort", [], [5])]))
    rows = {r["id"]: r for r in n.collect()}
    assert set(rows) == {1, 2} and rows[1]["name"] == "Frankfurt am Main" and rows[1]["aliases"] == ["FFM"] and rows[1]["props"] == {"source": "local", "a": "2"}
    assert rows[2]["name"] == "X" and rows[2]["aliases"] == ["ex"]
    got = sorted((r["id"], r["src"], r["dst"], r["rel"], r["props"].get("k")) for r in e.collect())
    assert got == [(1, 2, 1, "IN", "v"), (2, 1, 2, "HAS", None)]


def test_fullname_clusters(spark):
    nodes = nodes_of(spark, [(1, "Firma", "Kurz", [], {"fullName": " Lang GmbH "}), (2, "Firma", "lang gmbh", [], {"full_name": "Kurz"}), (3, "Ort", "Lang GmbH", [], {}), (4, "Ort", "Z", [], {"fullName": "nirgends"})])
    assert [(r["prefLabel"], r["alias"], r["a"], r["b"]) for r in graph.fullname_clusters(nodes).collect()] == [("lang gmbh", "Kurz", 1, 2)]


def test_unify_overlapping(spark):
    m = [(1, "b", 1), (1, "b", 2), (2, "a", 2), (2, "a", 3), (3, "c", 3), (3, "c", 4), (3, "c", 5), (9, "z", 50)]
    got = {r["cluster"]: (r["component"], r["pref"]) for r in graph.unify_overlapping(spark.createDataFrame(m, "cluster bigint, prefLabel string, member bigint")).collect()}
    assert got == {1: (1, "c"), 2: (1, "c"), 3: (1, "c"), 9: (9, "z")}


def test_merge_nodes_and_edges(spark):
    e = spark.createDataFrame([(" A ", "L1", {"k": "1"}, 0), ("A", "L2", {"k": "2", "j": "x"}, 1), ("", "L", {}, 2), (None, "L", {}, 3), ("B", "L", {}, 4)], f"name string, label string, props {PROPS}, ord bigint")
    n = {r["name"]: (r["label"], r["props"]) for r in graph.merge_nodes(e).collect()}
    assert n == {"A": ("L1", {"k": "2", "j": "x"}), "B": ("L", {})}
    ids = spark.createDataFrame([(0, "A"), (1, "B")], "id bigint, name string")
    d = spark.createDataFrame([("A", "r", "B", 0), ("A ", "r", "B", 1), ("A", "r", "A", 2), ("A", "r", "C", 3)], "src string, rel string, dst string, ord bigint")
    assert [tuple(r) for r in graph.resolve_edges(d, ids).collect()] == [(0, "r", 1, 0)]


def test_graph_context(spark, monkeypatch):
    articles = spark.createDataFrame([("a.md", "Alpha und Beta"), ("b.md", "gamma DELTA"), ("c.md", "gamma"), ("_index.md", "alpha beta gamma delta"), ("d.md", None)], "name string, content string")
    nodes = nodes_of(spark, [(1, "T", "Alpha", [], {"description": "erste"}), (2, "T", "Beta", ["BB"], {}), (3, "T", "Gamma", [], {}), (4, "T", "Delta", [], {})])
    edges = edges_of(spark, [(1, 3, "USES", {}), (2, 4, "unknown_rel", {}), (1, 2, "OFFERS", {}), (1, 2, "OFFERS", {}), (3, 4, "USES", {})])
    for size in (graph.TERM_BYTES, 8):
        monkeypatch.setattr(graph, "TERM_BYTES", size)
        found = graph.article_entities(articles, graph.terms_of(nodes))
        assert {r["name"]: r["entities"] for r in found.collect()} == {"a.md": ["Alpha", "Beta"], "b.md": ["Gamma", "Delta"], "c.md": ["Gamma"]}
    chosen = spark.createDataFrame([("a.md",)], "name string")
    assert {(r["name"], r["is_extra"]) for r in graph.expand(chosen, found, nodes, edges).collect()} == {("a.md", False), ("b.md", True)}
    facts = [tuple(r) for r in graph.context_facts(chosen, found, nodes, edges).orderBy("ord").collect()]
    assert facts == [(1, "Alpha", "bietet an", "Beta"), (2, "Alpha", "nutzt", "Gamma"), (3, "Beta", "unknown_rel", "Delta")]
    n, e = graph.restrict(found.filter("name = 'c.md'"), nodes, edges)
    assert [r["id"] for r in n.collect()] == [3] and e.count() == 0
    block = graph.context_block([{"src": "A", "phrase": "nutzt", "dst": "B"}], [{"name": "A", "label": "T", "description": "x"}])
    assert block == "## Wissensgraph\n\n### Entitäten\n- **A** (T): x\n\n### Beziehungen\n- A nutzt B" and graph.context_block([], []) == ""


def test_restricted_graph_holds_all_articles_of_a_view(spark, tmp_path):
    """Against brute force: terms that only later articles of the view mention are in the graph, those of other sources are not."""
    from quern.plans import catalog

    words = ["alpha", "beta", "delta", "gamma", "kappa", "omega", "sigma", "theta", "zeta"]
    texts = [(d, "src" + str(d % 4), f"Text of {words[d % len(words)].upper()} and more") for d in range(1, 8)] + [(d, "src2", "nothing") for d in range(20, 30)] + [(30, "src1", "sigma"), (31, "src0", "zeta")]
    spark.createDataFrame([(d, t, "en", s, len(t)) for d, s, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"{w} asks") for k, w in enumerate(words)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {k for k, w in enumerate(words, 1) if any(w in t.lower() for _, s, t in texts if s in ("src1", "src2"))}
    edges = {a * 10 + mark for a in seen for step, mark in ((1, 1), (7, 2)) if a + step in seen}
    got = [tuple(r) for r in catalog.queries()["graph_restrict"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([("node", k) for k in seen] + [("edge", k) for k in edges])


def test_answer(spark):
    articles = spark.createDataFrame([("a.md", "Alpha und Beta"), ("b.md", "gamma DELTA"), ("_index.md", "x")], "name string, content string")
    nodes = nodes_of(spark, [(1, "T", "Alpha", [], {"description": "erste"}), (2, "T", "Beta", [], {}), (3, "T", "Gamma", [], {}), (4, "T", "Delta", [], {})])
    edges = edges_of(spark, [(1, 3, "USES", {}), (2, 4, "USES", {})])
    seen = []

    def call(messages):
        seen.append(messages)
        return "a.md, nothing.md" if len(seen) == 1 else "fertig"

    out = retrieval.answer("Was?", articles, nodes, edges, call, history=[{"role": "user", "content": str(k)} for k in range(30)])
    assert out == {"sources": ["a", "b"], "answer": "fertig"}
    assert "- a.md  (Entitäten: Alpha, Beta)" in seen[0][0]["content"] and len(seen[1]) == 11 and "Alpha nutzt Gamma" in seen[1][-1]["content"]
    seen.clear()
    assert retrieval.answer("Was?", articles, nodes, edges, call, view=lambda a: a.filter("name = 'a.md'"))["sources"] == ["a"]


def log(spark, ok, codes):
    rows = [("d", k, "success", None) for k in range(ok)] + [("d", ok + k, "failed", c) for k, c in enumerate(codes)]
    return spark.createDataFrame(rows, "domain string, seq bigint, outcome string, code int")


@pytest.mark.parametrize(
    ("ok", "codes", "blocked", "top"),
    [(0, [429] * 8, True, 429), (0, [403] * 5, True, 403), (0, [247] * 6, True, 247), (50, [404] * 2, False, None), (0, [429] * 2, False, None), (0, [None] * 5, False, None), (0, [404, 404, 404, 429, 429, 429], True, 404)],
)
def test_block_status(spark, ok, codes, blocked, top):
    r = crawl.block_status(log(spark, ok, codes)).first()
    assert (r["blocked"], r["top_status"], r["ok"], r["failed"]) == (blocked, top, ok, len(codes))


def test_abort_after_five_in_a_row(spark):
    assert crawl.abort_points(log(spark, 0, [429] * 20)).first()["abort_seq"] == 4
    assert crawl.abort_points(log(spark, 0, ([429] * 4 + [500]) * 4)).count() == 0
    assert crawl.abort_points(log(spark, 0, [429, 429, None, 429, 429, 429])).first()["abort_seq"] == 5


def test_crawl_by_levels(spark):
    filler = "Genug Text für eine Seite, die nicht übersprungen werden soll, weil sie lang genug ist."
    site = {
        "https://x.de": f'<html lang="de"><title>Start</title><p>{filler}</p><a href="/a">a</a><a href="/b">b</a><a href="https://other.de/">o</a></html>',
        "https://x.de/a": f'<html lang="de"><p>{filler}</p><a href="/c">c</a><a href="/">s</a></html>',
        "https://x.de/b": f'<html lang="en"><p>{filler}</p></html>',
        "https://x.de/c": f'<html lang="de"><p>{filler}</p><a href="/d">d</a></html>',
    }

    def fetch(url):
        return (200, "text/html", site[url]) if url in site else (404, "text/html", "")

    history = spark.createDataFrame([("https://x.de/c",)], "url string")
    out = {r["url"]: (r["depth"], r["outcome"], r["reason"]) for r in crawl.crawl("https://x.de", fetch, spark, max_depth=2, langs=["de"]).collect()}
    assert out == {"https://x.de": (0, "success", None), "https://x.de/a": (1, "success", None), "https://x.de/b": (1, "skipped", None), "https://x.de/c": (2, "success", None)}
    out = {r["url"]: r["outcome"] for r in crawl.crawl("https://x.de", fetch, spark, history=history, max_depth=3).collect()}
    assert out["https://x.de/c"] == "cached" and "https://x.de/d" not in out


FILLER = "Genug Text für eine Seite, die nicht übersprungen werden soll, weil sie lang genug ist."


def _site(codes):
    """A start page that links to one page for each code, in order."""
    links = "".join(f'<a href="/p{k}">x</a>' for k in range(len(codes)))
    answers = {f"https://x.de/p{k}": c for k, c in enumerate(codes)}

    def fetch(url):
        if url == "https://x.de":
            return 200, "text/html", f"<p>{FILLER}</p>{links}"
        if answers[url] is None:
            raise OSError("no network")
        return answers[url], "text/html", f"<p>{FILLER} {url}</p><a href='/p0'>s</a>"

    return fetch


@pytest.mark.parametrize(
    ("codes", "reached"),
    [([429] * 20, 5), (([429] * 4 + [200]) * 4, 20), ([429, 429, None, 429, 429, 429, 200], 6), ([200, 429, 429, 429, 429, 429, 200], 6)],
)
def test_crawl_ends_after_five_limits_in_a_row(spark, codes, reached):
    out = crawl.crawl("https://x.de", _site(codes), spark, max_depth=1)
    assert out.filter("depth = 1").count() == reached


def test_crawl_counts_limits_across_levels(spark):
    def fetch(url):
        return (200, "text/html", f"<p>{FILLER}</p><a href='/q'>x</a><a href='/r'>x</a><a href='/s'>x</a>") if url == "https://x.de" else (429, "", "")

    out = crawl.crawl("https://x.de", fetch, spark, max_depth=3, seeds=["https://x.de/1", "https://x.de/2", "https://x.de/3"])
    assert sorted((r["url"], r["code"]) for r in out.filter("code = 429").collect()) == [(f"https://x.de/{x}", 429) for x in ("1", "2", "3", "q", "r")]


@pytest.mark.parametrize("most", [1, 2, 5, 50])
def test_crawl_keeps_exactly_so_many_pages(spark, most):
    out = crawl.crawl("https://x.de", _site([200, 404, 200, 500] * 4), spark, max_depth=2, max_pages=most)
    assert out.filter("outcome = 'success'").count() == min(most, 9)
    wanted = spark.createDataFrame([(f"https://x.de/p{k}", k) for k in range(16)], "url string, ord bigint")
    got = crawl.collect(wanted, _site([200, 404, 200, 500] * 4), max_pages=most).filter("outcome = 'success'")
    assert sorted(r["parent_ord"] for r in got.collect()) == list(range(0, 16, 2))[:most]


def test_documents(spark):
    d = spark.createDataFrame([("a", "h", 3), ("b", "h2", 2), ("c", "h", 4), ("new", "h", 2), ("zero", "h", 0)], "key string, hash string, pages_total int")
    m = spark.createDataFrame([("a", "h", 3, [1, 3]), ("b", "old", 2, [1, 2]), ("c", "h", 3, [1, 2, 3])], "key string, hash string, pages_total int, pages_done array<int>")
    assert {r["key"]: r["pending"] for r in documents.pending(d, m).collect()} == {"a": [2], "b": [1, 2], "c": [1, 2, 3, 4], "new": [1, 2], "zero": []}
    p = spark.createDataFrame([("a", k, "x" * (200 if k % 2 else 0)) for k in range(1, 9)], "doc string, page_no bigint, text string")
    r = documents.budgeted(documents.routed(p), 2)
    assert sorted(x["page_no"] for x in r.filter("included").collect()) == [1, 2, 3, 4, 5, 7]
    assert documents.report(r).first().asDict() == {"documents": 1, "pages": 8, "text_pages": 4, "vision_pages": 2, "left_out": 2}
    for bad in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError, match="label"):
            documents.validate_label(bad)
    f = spark.createDataFrame([("x.PDF", b"one|two"), ("y.txt", b"no"), ("z.pdf", None)], "path string, content binary")
    assert [(r["doc"], r["page_no"], r["text"]) for r in documents.pdf_pages(f, lambda c: c.decode().split("|")).collect()] == [("x.PDF", 1, "one"), ("x.PDF", 2, "two")]


def test_prune_and_changed(spark):
    m = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "slug string, digest string")
    kept, empty = inventory.prune(m, spark.createDataFrame([("1",)], "digest string"))
    assert [(r["slug"], r["members"]) for r in kept.collect()] == [("a", ["1"])] and [r["slug"] for r in empty.collect()] == ["b"]
    now, before = inventory.fingerprints(m), inventory.fingerprints(m.filter("digest <> '3'").union(spark.createDataFrame([("b", "4")])))
    assert [r["slug"] for r in inventory.changed(now, before).collect()] == ["b"]
    assert inventory.orphans(spark.createDataFrame([("x.md",), ("_i.md",)], "name string"), m.limit(0)).count() == 0


def test_unique_slugs(spark):
    def naive(bases, taken):
        out = []
        for b in bases:
            name, k = b, 2
            while name in taken:
                name, k = f"{b}-{k}", k + 1
            taken.add(name)
            out.append(name)
        return out

    import random

    rng = random.Random(1)
    name = lambda: rng.choice("ab") + "".join(f"-{rng.randint(2, 4)}" for _ in range(rng.choice([0, 0, 0, 1, 1, 2])))
    cases = [([name() for _ in range(rng.randint(1, 120))], {name() for _ in range(rng.randint(0, 4))}) for _ in range(6)] + [(["only"] * 300 + ["-2", "", ""], set())]
    for bases, taken in ((["x", "x-2", "x", "x", "y", "y", "x-2"], set()), (["x", "x", "z"], {"x-2", "z"}), (["a-3", "a", "a", "a", "a"], set()), *cases):
        df = spark.createDataFrame([(b, i) for i, b in enumerate(bases)], "slug string, ord bigint")
        have = spark.createDataFrame([(t,) for t in taken], "slug string")
        got = [r["unique_slug"] for r in inventory.unique_slugs(df, taken=have).orderBy("ord").collect()]
        assert got == naive(bases, set(taken))


def test_context_budget_counts_excluded_pages(spark):
    rows = [("a", k, "x" * n) for k, n in enumerate([1500, 2000, 10, 1500])] + [("b", 9000, "y"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, ord bigint, text string")
    got = {(r["g"], r["ord"]): r["included"] for r in inventory.context_budget(df, "g", "ord", most=3005).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 9000): True, ("b", 1): True}


def test_numbered_batches(spark):
    df = spark.range(100).select(F.format_string("%03d", "id").alias("digest"))
    got = distill.numbered(df.repartition(7), 15).orderBy("digest").collect()
    assert [r["batch"] for r in got] == [k // 15 for k in range(100)]
    assert distill.numbered(df.limit(0), 15).count() == 0


def reply(pages, most):
    return json.dumps({"pages": [{"id": f"p{i}", "title": p["digest"]} for i, p in enumerate(pages[:most])]})


def test_partial_replies_are_asked_again_in_halves():
    pages = [{"digest": f"d{k}", "language": "", "body": "b", "source": f"s{k}"} for k in range(10)]
    calls = []

    def call(prompt, model, n):
        ids = [x for x in prompt.split("\n") if x.startswith("### PAGE")]
        calls.append(len(ids))
        return json.dumps({"pages": [{"id": f"p{i}", "title": "t"} for i in range(min(4, len(ids)))]})

    rows = list(distill.distill_batch(pages, call, "m", "p"))
    assert {r["digest"] for r in rows if r["ok"]} == {f"d{k}" for k in range(10)} and calls == [10, 3, 3]
    calls.clear()
    rows = list(distill.distill_batch(pages, lambda *a: calls.append(1) or "{}", "m", "p"))
    assert len(calls) == 1 and not any(r["ok"] for r in rows)

    def broken(*a):
        raise TimeoutError("late")

    rows = list(distill.distill_batch(pages, broken, "m", "p"))
    assert len(rows) == 10 and "TimeoutError: late" in rows[0]["error"] and "s0, s1, s2 … (+7 weitere)" in rows[0]["error"]


def test_batches_of_a_task_run_in_threads(spark, tmp_path):
    import os
    import time

    folder = str(tmp_path)

    def call(prompt, model, n):
        mark = f"{folder}/{time.time_ns()}-{os.getpid()}"
        open(f"{mark}.begin", "w").close()
        time.sleep(0.5)
        open(f"{folder}/{time.time_ns()}-{os.getpid()}.end", "w").close()
        ids = [x.split()[2] for x in prompt.split("\n") if x.startswith("### PAGE")]
        return json.dumps({"pages": [{"id": i, "title": "t"} for i in ids]})

    raw = spark.createDataFrame([(f"a/{k}.md", f"Seite {k} mit Text.") for k in range(8)], "rel string, content string")
    store = spark.createDataFrame([], "digest string, title string, summary string, sources array<string>")
    assert distill.distill_all(raw, store, call, jobs=4, batch_size=2).made.count() == 8
    open_, most = {}, 0
    for f in sorted(os.listdir(folder)):
        pid = f.split("-")[1].split(".")[0]
        open_[pid] = open_.get(pid, 0) + (1 if f.endswith("begin") else -1)
        most = max(most, open_[pid])
    assert most > 1


def test_ensured_metadata():
    fixed = lambda c: retrieval.ensured_metadata(c, "T", ["b.md", "a.md"], "2026-01-02")
    want = '---\ntitle: X\nsources: ["a.md", "b.md"]\ncompiled: "2026-01-02"\n---\n\nBody\n'
    assert fixed("---\ntitle: X\nsources:\n  - wrong\ncompiled: 1999\n---\n\nBody\n") == want
    assert fixed("```yaml\ntitle: X\n---\nBody\n") == want
    assert fixed("```yaml\n---\ntitle: X\n---\nBody\n") == want
    assert fixed("Body\n") == want.replace("title: X", 'title: "T"')
    assert retrieval.ensured_metadata("Body\n", 'A: b "c"', [], "2026-01-02").startswith('---\ntitle: "A: b \\"c\\""\nsources: []\n')


def test_chats_and_export(spark, tmp_path):
    c = spark.createDataFrame([("u", "1", "old"), ("u", "2", "keep")], "bucket string, id string, title string")
    n = spark.createDataFrame([("u", "1", "new"), ("u", "../x", "bad")], "bucket string, id string, title string")
    assert sorted((r["id"], r["title"]) for r in retrieval.upsert_chats(c, n).collect()) == [("1", "new"), ("2", "keep")]
    assert retrieval.delete_chat(c, "u", "9").count() == 2
    (tmp_path / "d/chats").mkdir(parents=True)
    for f in ("a.md", "b.tmp", ".DS_Store", "chats/c.json"):
        (tmp_path / "d" / f).write_text("x")
    assert files.write_export(str(tmp_path / "d"), str(tmp_path / "o.zip"), chats=False) == (1, 1)
    import zipfile

    assert zipfile.ZipFile(tmp_path / "o.zip").namelist() == ["data/a.md"]
    with pytest.raises(ValueError, match="itself"):
        files.write_export(str(tmp_path / "d"), str(tmp_path / "d/o.zip"))
    with pytest.raises(FileNotFoundError):
        files.write_export(str(tmp_path / "none"), str(tmp_path / "p.zip"))
    (tmp_path / "t.zip").mkdir()  # the move onto a folder fails
    with pytest.raises(OSError):
        files.write_export(str(tmp_path / "d"), str(tmp_path / "t.zip"))
    assert not [f for f in tmp_path.iterdir() if f.name.endswith(".tmp")]


def test_files(spark, tmp_path):
    (tmp_path / "w x/sub").mkdir(parents=True)
    (tmp_path / "w x/a.md").write_text("one\ntwo")
    (tmp_path / "w x/sub/b+c.md").write_text("three")
    (tmp_path / "w x/n.txt").write_text("no")
    got = {r["rel"]: r["content"] for r in files.read_markdown(spark, str(tmp_path / "w x")).collect()}
    assert got == {"a.md": "one\ntwo", "sub/b+c.md": "three"}
    assert [r["name"] for r in files.read_wiki(spark, str(tmp_path / "w x")).collect()] == ["a.md"]
    assert files.graph_folders("DE", "ab") == ["graph-ab-de", "graph-ab"] and files.graph_folders() == ["graph"]
    (tmp_path / "graph").mkdir()
    (tmp_path / "graph/nodes.json").write_text('[{"id": 1, "name": "x"}]')
    (tmp_path / "graph/edges.json").write_text("[]")
    assert files.read_graph(spark, str(tmp_path), "de")[0].count() == 1 and files.read_graph(spark, str(tmp_path), namespace="q")[0].count() == 0
    files.save_json(str(tmp_path / "s.json"), {"schema": 1, "clusters": []})
    assert files.load_inventory(str(tmp_path / "s.json"))["schema"] == 1 and files.load_inventory(str(tmp_path / "none")) == {"schema": 1, "clusters": []}
    (tmp_path / "bad.json").write_text("{")
    assert files.load_json(str(tmp_path / "bad.json"), {}) == {}
    with pytest.raises(ValueError):
        files.load_json(str(tmp_path / "bad.json"), {}, strict=True)


def test_sitemap_cap_counts_kept_addresses(spark):
    locs = ["https://y.de/b"] * 6 + ["https://x.de/a", "https://x.de/a/", "https://x.de/c", "https://x.de/d", "https://x.de/e"]
    xml = "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"
    got = sitemap.locations(spark.createDataFrame([("x.de", xml)], "domain string, xml string"), most=3).orderBy("ord").collect()
    assert [(r["url"], r["ord"]) for r in got] == [("https://x.de/a", 6), ("https://x.de/c", 8), ("https://x.de/d", 9)]


def test_robots_and_sitemaps():
    text = "User-agent: *\n\nDisallow: /private\nSITEMAP: https://x.de/s.xml\n"
    ok = robots.allowed(text, "me")
    assert ok("https://x.de/a") and not ok("https://x.de/private/b") and robots.allowed(None, "me")("any")
    import gzip

    site = {
        "https://x.de/robots.txt": text.encode(),
        "https://x.de/s.xml": b"<sitemapindex><sitemap><loc>https://x.de/1.xml.gz</loc></sitemap><sitemap><loc>https://x.de/s.xml</loc></sitemap></sitemapindex>",
        "https://x.de/1.xml.gz": gzip.compress(b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.de/a/#f</loc></url><url><loc>https://y.de/b</loc></url><url><loc>https://x.de/c</loc></url></urlset>'),
    }
    assert sitemap.discover("https://x.de", site.get) == ["https://x.de/a", "https://x.de/c"]
    assert sitemap.discover("https://x.de", site.get, most=1) == ["https://x.de/a"] and sitemap.discover("https://q.de", site.get) == []


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["a", "b"])], "x array<string>, y array<string>")
    assert df.select(fingerprint(F.col("x")) == fingerprint(F.col("y"))).first()[0]
