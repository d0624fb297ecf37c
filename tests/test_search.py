"""Many strings in many texts against ``in``, plain SQL, and the matching of articles in blocks."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quern.functions import search
from quern.operators import graph


@pytest.mark.parametrize("part", [None, 16])
def test_strings_are_found_as_by_in(monkeypatch, part):
    if part:
        monkeypatch.setattr(search, "PART_BYTES", part)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcä \n") for _ in range(n)).encode()
    strings = list({word(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 20, 70, 80])) for _ in range(400)})
    texts = [word(rng.randint(0, 200)) for _ in range(60)] + [b"", strings[0], b"x" + strings[5] + strings[6], b"a" * 500]
    got = {(r, n) for rows, numbers in search.Strings(strings).search(texts) for r, n in zip(rows.tolist(), numbers.tolist(), strict=True)}
    assert got == {(r, n) for r, t in enumerate(texts) for n, s in enumerate(strings) if s in t}
    assert list(search.Strings([]).search(texts)) == []


def test_blocks_give_what_one_search_gives(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 6))).strip() or "z" for _ in range(80)]
    nodes = spark.createDataFrame([(i, "L", n.upper(), [names[(i * 7) % 80], "", "line\nbreak"], {}, i) for i, n in enumerate(names)], "id bigint, label string, name string, aliases array<string>, props map<string,string>, ord bigint")
    articles = spark.createDataFrame([(f"{k}.md", " ".join(rng.choice(names) for _ in range(12)) + ("line\nBreak" if k == 3 else "")) for k in range(30)] + [("_index.md", "abc"), ("none.md", None)], "name string, content string")
    terms = graph.terms_of(nodes)
    get = lambda size: {r["name"]: r["entities"] for r in graph.article_entities(articles, terms, size).collect()}
    whole = get(1 << 20)
    places = [(r["term"], r["name"]) for r in terms.orderBy("place").collect()]
    for r in articles.collect():
        want = list(dict.fromkeys(n for t, n in places if t in (r["content"] or "").lower()))
        assert whole.get(r["name"], []) == ([] if r["name"].startswith("_") else want)
    assert get(200) == whole == get(3000)


def test_a_task_holds_few_articles_at_a_time(spark, tmp_path, monkeypatch):
    """Long articles in one partition: a task's Python sees some megabytes of them at a time, and all of them."""
    from pyspark.sql import functions as F

    log = str(tmp_path / "bytes")

    class Noted(search.Strings):
        def search(self, texts):
            with open(log, "a") as f:
                f.write(f"{sum(map(len, texts))}\n")
            return search.Strings.search(self, texts)

    monkeypatch.setattr(graph, "Strings", Noted)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    articles = spark.range(0, 1500, 1, 1).select(F.concat(F.lit("d"), "id").alias("name"), F.concat(F.repeat(F.lit("abcdefghi "), 2000), F.lit("k"), F.col("id") % 3).alias("content"))
    terms = spark.createDataFrame([(f"k{k}", f"K{k}", (k, 0)) for k in range(2)], "term string, name string, place struct<ord:bigint,k:int>")
    got = {r["name"]: r["entities"] for r in graph.article_entities(articles, terms).collect()}
    assert got == {f"d{i}": [f"K{i % 3}"] for i in range(1500) if i % 3 < 2} and spark.conf.get(name) == was
    held = [int(x) for x in Path(log).read_text().split()]
    assert sum(held) == 1500 * 20_002 and max(held) < 6 << 20


def test_a_million_terms_equal_sql(spark, tmp_path):
    """Terms of a million nodes in a few articles, in blocks, against SQL; and what a process needs for them."""
    n = 1_000_000
    spark.range(n).selectExpr("id", "concat(substr(sha2(cast(id as string), 256), 1, 4), ' ', id) as term").write.parquet(str(tmp_path / "terms"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW terms AS SELECT * FROM '{tmp_path}/terms/*.parquet'")
    texts = [" ".join(r[0] for r in con.execute(f"SELECT term FROM terms WHERE id % {m} = 7 ORDER BY id LIMIT 150").fetchall()) for m in (1009, 5003, 9973, 10)]
    articles = spark.createDataFrame([(f"{k}.md", t) for k, t in enumerate(texts)], "name string, content string")
    from pyspark.sql import functions as F

    terms = spark.read.parquet(str(tmp_path / "terms")).select("term", F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"), F.struct(F.col("id").alias("ord"), F.lit(0).alias("k")).alias("place"))
    got = {(r["name"], e) for r in graph.article_entities(articles, terms).collect() for e in r["entities"]}
    con.register("articles", articles.toPandas())
    want = set(con.execute("SELECT a.name, 'N' || t.id FROM articles a JOIN terms t ON contains(a.content, t.term)").fetchall())
    assert got == want and len(want) > 500


def test_a_block_of_terms_is_small():
    code = """
import resource
from quern.functions.search import Strings
terms = [b"%06x term %d" % (i * 2654435761 %% (1 << 24), i) for i in range(400_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = Strings(terms)
list(s.search([b" ".join(terms[:5000])]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
""".replace("%%", "%")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parent.parent)
    assert float(out.stdout) < 220  # some 7 MB of terms
