"""The compile run: what is unchanged costs nothing; streams take in what arrives."""

from __future__ import annotations

import pytest

from quern.plans.compile import State, compile_corpus
from quern.provider import EchoModel, ModelAuthError, retrying, retrying_stream
from quern.streaming.incremental import compile_stream, failures_by_window, latest_status


def page(n, body, lang="de"):
    return (f"d/{n}.md", f'---\ntitle: "P{n}"\ndomain: "d"\nlanguage: "{lang}"\n---\n\n{body}\n')


def raw(spark, rows):
    return spark.createDataFrame(rows, "rel string, content string")


class Counting:
    """A model on executors whose calls are counted by a Spark accumulator."""

    def __init__(self, spark):
        self.calls, self.model = spark.sparkContext.accumulator(0), EchoModel()

    def __call__(self, *args):
        self.calls.add(1)
        return self.model(*args)


def test_second_run_is_free_and_changes_stay_local(spark, tmp_path):
    state, call = State(spark, f"file://{tmp_path}/state"), Counting(spark)
    rows = [page(k, f"Seite Nummer {k} über Dinge und Sachen.") for k in range(5)] + [("d/copy.md", page(0, "Seite Nummer 0 über Dinge und Sachen.")[1])]
    first = compile_corpus(raw(spark, rows), state, call, today="2026-01-01")
    assert (first.pages, first.distilled, first.failed) == (5, 5, 0) and first.changed == ["sammlung.md"] and first.graph_built and first.index_built
    assert state.read("articles").count() == 2 and state.read("nodes").count() > 0
    calls, version = call.calls.value, state.version()
    again = compile_corpus(raw(spark, rows), state, call, today="2026-01-02")
    assert call.calls.value == calls and state.version() == version and not again.changed and not again.graph_built and again.distilled == 0
    third = compile_corpus(raw(spark, [*rows[1:], page(9, "Eine ganz neue Seite.")]), state, call)
    assert third.distilled == 1 and "sammlung-2.md" in third.changed and third.pages == 6  # the copy still holds page 0's content
    empty = compile_corpus(raw(spark, rows[:0]), state, call)
    assert empty.pages == 0 and empty.removed == []  # an empty inventory orphans nothing


def test_prompts_lint_and_suggestions(spark, tmp_path):
    from quern.plans.compile import cached_suggestions
    from quern.plans.prompts import DEFAULTS, prompts

    assert all(DEFAULTS["de"].keys() == p.keys() and all(p.values()) for p in DEFAULTS.values())
    assert prompts("EN-us") == DEFAULTS["en"] and prompts("xx", {"lint": "own"}) == DEFAULTS["de"] | {"lint": "own"}
    folder = tmp_path / "seen"
    folder.mkdir()
    where = str(folder)

    def call(prompt, model="", n=0):
        from quern.plans.prompts import DEFAULTS

        kind = next((k for k, v in DEFAULTS["en"].items() if prompt.startswith(v)), "?")
        with open(f"{where}/{kind}", "a") as f:
            f.write("x")
        return '["What?"]' if kind == "suggestions" else "fine" if kind == "lint" else EchoModel()(prompt)

    state = State(spark, f"file://{tmp_path}/state")
    assert cached_suggestions(state, call, prompt=DEFAULTS["en"]["suggestions"]) == []
    compile_corpus(raw(spark, [page(1, "Frankfurt Messe")]), state, call, language="en", with_lint=True, canonicalize=True)
    assert {f.name for f in folder.iterdir()} == {"distill", "assign", "article", "lint", "canonicalize"}
    assert state.read("articles").filter("name = '_lint-report.md'").first()["content"] == "fine"
    for _ in range(2):
        assert cached_suggestions(state, call, prompt=DEFAULTS["en"]["suggestions"]) == ["What?"]
    assert (folder / "suggestions").read_text() == "x"


def test_command_line(spark, tmp_path, capsys):
    from quern import cli

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.md").write_text(page(1, "Frankfurt Messe")[1])
    state = ["--state", f"file://{tmp_path}/state"]
    cli.main(["compile", "--raw", str(tmp_path / "raw"), *state, "--wiki-dir", str(tmp_path / "wiki"), "--lint", "--jobs", "2"])
    assert {f.name for f in (tmp_path / "wiki").iterdir()} == {"_index.md", "_lint-report.md", "sammlung.md"}
    cli.main(["ask", "Was?", *state])
    cli.main(["suggestions", *state])
    cli.main(["queries"])
    out = capsys.readouterr().out
    assert "distilled=1" in out and "articles written: 3" in out and "none" in out and "raw_scan" in out


def test_filters_of_a_run(spark, tmp_path):
    state = State(spark, f"file://{tmp_path}/state")
    rows = [page(1, "Deutsch."), page(2, "English.", "en"), ("e/3.md", "no block at all")]
    assert compile_corpus(raw(spark, rows), state, EchoModel(), domains=["D"], langs=["de"]).pages == 1


def test_graph_with_a_model(spark, tmp_path):
    import json

    def call(prompt, model="", n=0):
        if "### PAGE" in prompt or "### DOC" in prompt:
            return EchoModel()(prompt)
        rows = json.loads(prompt[prompt.index("[") :]) if "[{" in prompt else []
        ids = [r["id"] for r in rows if r["name"].startswith("Frank")]
        return json.dumps({"clusters": [{"prefLabel": "Frankfurt", "label": "Begriff", "aliases": ["FFM"], "member_ids": ids}]}) if ids else "none"

    state = State(spark, f"file://{tmp_path}/state")
    compile_corpus(raw(spark, [page(1, "Frankfurt Messe"), page(2, "Frankreich Paris")]), state, call, canonicalize=True)
    names = {r["name"]: r["aliases"] for r in state.read("nodes").collect()}
    assert names["Frankfurt"] == ["FFM"] and "Frankreich" not in names and "Messe" in names


def test_stream_takes_each_file_once(spark, tmp_path):
    state, call = State(spark, f"file://{tmp_path}/state"), Counting(spark)
    run = lambda: compile_stream(spark, f"{tmp_path}/in", f"file://{tmp_path}/corpus", state, call, f"{tmp_path}/check")
    raw(spark, [page(1, "Eins und mehr."), page(2, "Zwei und mehr.")]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    assert [r.distilled for r in run()] == [2]
    calls = call.calls.value
    assert run() == [] and call.calls.value == calls
    raw(spark, [page(2, "Zwei, nun anders."), page(3, "Drei und mehr.")]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    (report,) = run()
    assert report.distilled == 2 and report.pages == 3


def test_the_page_that_arrived_last_wins(spark, tmp_path):
    import os

    for k, body in enumerate(["Zuerst: zzz am Ende.", "Danach: aaa am Anfang."]):
        raw(spark, [page(1, body)]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        for f in os.listdir(tmp_path / "in"):
            if f.endswith(".parquet") and os.path.getmtime(tmp_path / "in" / f) > 10**9 + 10:
                os.utime(tmp_path / "in" / f, (10**9 + k, 10**9 + k))
    state = State(spark, f"file://{tmp_path}/state")
    compile_stream(spark, f"{tmp_path}/in", f"file://{tmp_path}/corpus", state, EchoModel(), f"{tmp_path}/check")
    corpus = State(spark, f"file://{tmp_path}/corpus")
    assert "Danach" in spark.read.parquet(f"{corpus.root}/v={corpus.version()}/raw").first()["content"]


def test_a_run_that_dies_leaves_the_state_before_it(spark, tmp_path, monkeypatch):
    state = State(spark, f"file://{tmp_path}/state")
    compile_corpus(raw(spark, [page(1, "Eins und mehr.")]), state, EchoModel())
    assert state.version() == 0

    def dies(version, keep=2):
        raise OSError("lost")

    monkeypatch.setattr(state, "complete", dies)
    with pytest.raises(OSError):
        compile_corpus(raw(spark, [page(1, "Eins und mehr."), page(2, "Zwei und mehr.")]), state, EchoModel())
    monkeypatch.undo()
    assert state.version() == 0 and state.read("store").count() == 1
    for k in range(3, 6):
        compile_corpus(raw(spark, [page(k, f"Seite {k} und mehr.")]), state, EchoModel())
    assert state.versions() == [2, 3] and state.read("store").count() == 1


def test_crawl_status_of_the_last_crawl_wins(spark):
    log = lambda d, code, n: spark.createDataFrame([(d, k, "failed", code) for k in range(n)], "domain string, seq bigint, outcome string, code int")
    first = latest_status(spark.createDataFrame([], "domain string, ok bigint, failed bigint, blocked boolean, reason string, top_status int"), log("a", 429, 5).union(log("b", 403, 5)))
    now = latest_status(first, log("a", 404, 2))
    assert {r["domain"]: r["blocked"] for r in now.collect()} == {"a": False, "b": True}
    windows = failures_by_window(spark.sql("SELECT 'a' AS domain, timestamp'2026-01-01 00:01:00' AS ts, 'failed' AS outcome, 429 AS code"))
    assert windows.first()["limited"] == 1


def test_provider():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    waits = []
    assert retrying(flaky, sleep=waits.append)(1) == "yes" and waits == [5.0, 10.0]

    def refused(x):
        calls.append(x)
        raise ModelAuthError

    calls.clear()
    with pytest.raises(ModelAuthError):
        retrying(refused, sleep=waits.append)(1)
    assert len(calls) == 1

    def torn():
        yield "a"
        raise OSError("no")

    with pytest.raises(OSError):
        list(retrying_stream(torn, sleep=waits.append)())


def test_a_cluster_needs_a_shared_folder():
    from quern.state import is_local

    assert is_local("local") and is_local("local[8]") and is_local("local[*, 3]")
    assert not any(map(is_local, ("local-cluster[3,2,3000]", "spark://h:7077", "yarn", "k8s://https://h")))


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)


@pytest.mark.parametrize("kind", ["markdown", "parquet"])
def test_a_folder_that_did_not_change_is_listed_and_not_read(spark, tmp_path, kind):
    import os

    from quern.plans.folder import Files, compile_folder

    folder, state, call = tmp_path / "raw", State(spark, f"file://{tmp_path}/state"), Counting(spark)
    rows = [page(k, f"Seite Nummer {k} über Dinge und Sachen.") for k in range(6)] + [("d/a b+c.md", page(0, "Seite Nummer 0 über Dinge und Sachen.")[1])]
    if kind == "markdown":
        for name, content in rows:
            write(folder, name, content)
    else:
        raw(spark, rows).repartition(3, "rel").write.parquet(str(folder))
    files = Files(spark, str(folder), kind)
    first = compile_folder(files, state, call)
    assert (first.pages, first.distilled, first.failed) == (6, 6, 0) and first.graph_built
    assert state.read("store").filter("size(sources) = 2").first()["sources"] == ["d/0.md", "d/a b+c.md"]
    calls, version = call.calls.value, state.version()
    # other bytes of the same size and time: a run that read them would fail or find something new
    for path in (p for p in folder.rglob("*") if p.suffix in (".md", ".parquet") and not p.name.startswith(".")):
        at = path.stat()
        path.write_bytes(b"x" * at.st_size)
        os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))
        if (crc := path.with_name(f".{path.name}.crc")).exists():
            crc.unlink()
    again = compile_folder(files, state, call)
    assert again.pages == 6 and call.calls.value == calls and state.version() == version and not again.graph_built


def test_only_changed_files_are_read(spark, tmp_path):
    import os

    from quern.plans.folder import Files, compile_folder

    folder, state, call = tmp_path / "raw", State(spark, f"file://{tmp_path}/state"), Counting(spark)
    for k in range(4):
        write(folder, *page(k, f"Seite Nummer {k} über Dinge und Sachen."))
    files = Files(spark, str(folder))
    compile_folder(files, state, call)
    at = (folder / "d/3.md").stat()
    (folder / "d/3.md").write_bytes(b"y" * at.st_size)  # not noticed: same size and time
    os.utime(folder / "d/3.md", ns=(at.st_atime_ns, at.st_mtime_ns))
    write(folder, *page(1, "Jetzt etwas ganz anderes auf dieser Seite."))
    (folder / "d/0.md").unlink()
    write(folder, *page(9, "Neu."))
    report = compile_folder(files, state, call)
    assert (report.pages, report.distilled) == (4, 2)
    assert sorted(s for r in state.read("store").collect() for s in r["sources"]) == ["d/1.md", "d/2.md", "d/3.md", "d/9.md"]
    # the same state as a run over all texts would have left
    (folder / "d/3.md").write_text(page(3, "Seite Nummer 3 über Dinge und Sachen.")[1])
    assert compile_folder(files, state, call).distilled == 0
    other = compile_folder(files, state, call, domains=["elsewhere"])
    assert other.pages == 0  # other settings are another run


def test_failed_pages_of_unchanged_files_are_tried_again(spark, tmp_path):
    from quern.plans.folder import Files, compile_folder

    folder, state = tmp_path / "raw", State(spark, f"file://{tmp_path}/state")
    write(folder, *page(0, "Eine Seite über Dinge und Sachen."))

    def broken(*_):
        raise OSError("no model")

    assert compile_folder(Files(spark, str(folder)), state, broken).failed == 1
    assert compile_folder(Files(spark, str(folder)), state, EchoModel()).distilled == 1
    assert compile_folder(Files(spark, str(folder)), state, broken).pages == 1  # complete now: no call


def test_graph_and_canonical_steps_alone(spark, tmp_path):
    from quern.plans.compile import canonicalize_only, graph_only

    state = State(spark, f"file://{tmp_path}/state")
    assert canonicalize_only(state, EchoModel()) == (0, 0)
    compile_corpus(raw(spark, [page(k, f"Seite {k} über Dinge und Sachen.") for k in range(3)]), state, EchoModel())
    before, articles = state.read("nodes").count(), state.read("articles").count()
    state.write({"nodes": state.read("nodes").limit(0), "edges": state.read("edges").limit(0)})
    assert graph_only(state)[0] == before > 0
    assert canonicalize_only(state, EchoModel())[0] <= before and state.read("articles").count() == articles


def test_sums_of_a_changed_set_are_found_from_the_change(spark):
    from quern.operators.inventory import corpus_fingerprint, multiset_sums

    values = lambda names: spark.createDataFrame([(n,) for n in names], "digest string")
    row = lambda names: multiset_sums(values(names), "digest").first()
    a, came, went = row([f"k{i}" for i in range(50)]), row(["new"]), row(["k7"])
    after = row([*(f"k{i}" for i in range(50) if i != 7), "new"])
    assert [x + y - z for x, y, z in zip(a, came, went, strict=True)] == list(after)
    mark = lambda names: corpus_fingerprint(values(names)).first()[0]
    assert mark("abc") == mark("cbaab") != mark("abd") and mark("") != mark("a")


def test_corpus_fingerprint_hashes_all_digests_in_order(spark):
    import hashlib

    from quern.operators.inventory import _run_hashes, corpus_fingerprint

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted(f"sha256:{k % 7:03x}{sha(str(k))}" for k in range(200))
    runs = [(f"{k:03x}", sha("\n".join(x for x in digests if x[7:10] == f"{k:03x}"))) for k in range(7)]
    rows = [(d,) for d in [*digests, *digests[::3], None]]
    want = sha("v1\n" + "\n".join(h for _, h in runs))
    assert corpus_fingerprint(spark.createDataFrame(rows, "digest string")).first()[0] == want
    assert corpus_fingerprint(spark.createDataFrame([], "digest string")).first()[0] == sha("v1\n")

    import pyarrow as pa

    table = pa.table({"p": [d[7:10] for d in digests], "digest": digests})
    for rows_each in (1, 7, 29, 200):  # runs that go over several batches
        batches = [pa.RecordBatch.from_pydict({"p": [], "digest": []}, table.schema), *table.to_batches(rows_each)]
        out = pa.Table.from_batches(list(_run_hashes(batches)))
        assert list(zip(out["p"].to_pylist(), out["h"].to_pylist(), strict=True)) == runs
