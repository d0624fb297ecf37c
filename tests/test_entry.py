"""The driver's contract, and that the library stands without its optional subpackage."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["digest", "n_sources", "sources"] and df.count() == 189


def test_queries_and_sql_name_the_same_columns(spark):
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    sql = e.oracle_sql()
    assert set(sql) <= set(e.queries())
    for name, text in sql.items():
        assert con.execute(f"SELECT * FROM ({text}) LIMIT 0").description, name


NAMES = ["group_pages", "slugify", "raw_paths", "page_links", "distill_todo", "context_budget", "graph_edges", "merge_preflabel", "chat_tail", "crawl_block_status", "crawl_429_abort", "vision_budget", "pending_pages", "wiki_index", "raw_scan", "migrate_lang_counts", "prune_clusters", "graph_restrict", "sitemap_urls", "suggestions_parse", "bookmark_urls", "crawl_frontier", "distill_batches"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from quern.plans import catalog

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.queries()[name](spark, SF)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = sorted(con.execute(f"SELECT {cols} FROM ({catalog.oracle_sql()[name]})").fetchall())
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(want) and want


def _equals_sql(spark, name: str, folder: Path, **tables) -> int:
    """Whether a query and its SQL give the same rows over these tables, written to a folder; the number of rows."""
    from quern.plans import catalog

    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    got, want = df.collect(), con.execute(f"SELECT {cols} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return len(got)


REPEATED = [
    (1, "https://a.de/x"), (2, "http://b.de/x?p=2&ref=x"), (3, "https://a.de/y"), (4, "https://a.de/x"), (5, "http://a.de/x"), (6, "http://b.de/x?p=2&ref=x"), (7, 'https://a.de/"q"?a=1&lt;=2'),
    (8, "ftp://a.de/z"), (9, None), (10, "HTTPS://a.de/y"), (11, " https://c.de/1"), (11, "https://a.de/!"), (11, "https://a.de/"), (12, "https://a.de/y"), (None, "https://a.de/late"),
]


def test_bookmarks_of_repeated_addresses_equal_sql(spark, tmp_path):
    assert _equals_sql(spark, "bookmark_urls", tmp_path, pages=spark.createDataFrame(REPEATED, "page_id bigint, url string")) == 10


def test_plan_of_repeated_addresses_equals_sql(spark, tmp_path):
    assert _equals_sql(spark, "collect_plan", tmp_path, pages=spark.createDataFrame(REPEATED, "page_id bigint, url string")) == 12


def _without_the_subpackage(to: Path, also: bool) -> dict[str, str]:
    import shutil

    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *(["corpus_pipeline.py"] if also else []))
    shutil.copytree(ROOT, to, ignore=skip)
    shutil.rmtree(to / "quern" / "llm")
    shutil.rmtree(to / "tests" / "llm")
    # libraries may lie on an inherited path: the copy comes before it, this repository is left out
    inherited = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT]
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(to), *inherited])}


@pytest.mark.parametrize("also", [False, True])
@pytest.mark.parametrize("left", [False, True])
def test_library_stands_alone(tmp_path, also, left):
    """Without the optional subpackage, with or without the pipeline's file, the entry module still imports and lists the rest."""
    env = _without_the_subpackage(tmp_path / "r", also)
    if left:  # what an earlier import leaves behind
        (tmp_path / "r" / "quern" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=env)
    assert out.returncode == 0, out.stderr


def test_other_tests_stand_alone(tmp_path):
    """The other tests are collected without the optional subpackage."""
    env = _without_the_subpackage(tmp_path / "r", True)
    out = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "r", capture_output=True, text=True, env=env)
    assert out.returncode == 0, out.stdout + out.stderr


def test_errors_of_the_subpackage_are_not_hidden(tmp_path):
    """A library that the subpackage needs and does not find is an error, not an absence."""
    env = _without_the_subpackage(tmp_path / "r", True)
    (tmp_path / "r" / "quern" / "llm").mkdir()
    (tmp_path / "r" / "quern" / "llm" / "__init__.py").write_text("")
    (tmp_path / "r" / "quern" / "llm" / "queries.py").write_text("import a_library_that_is_not_there")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "r", capture_output=True, text=True, env=env)
    assert out.returncode and "a_library_that_is_not_there" in out.stderr


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "quern").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "quern.llm" not in f.read_text(), f
