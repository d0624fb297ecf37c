"""The pipeline's stages, each on its own input, against planted cases."""

from __future__ import annotations

import random

import corpus_pipeline as c
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdefglmnorstu") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, text(30)) for k in range(5)]
    docs = [(k, text(rng.randint(5, 200)), "en", "s") for k in range(120)]
    docs += [(200 + k, text(80) + " worthless idiot scum " + text(5), "en", "s") for k in range(30)]
    docs += [(300, docs[5][1], "en", "s"), (301, docs[6][1], "fr", "t"), (302, text(3) + " " + bench[0][1], "en", "s"), (303, text(120) + " mail me.now@host.example.org today " + text(9), "en", "s"), (304, None, None, None), (305, "", "en", "s")]
    labels = [(d_, 1, int(200 <= d_ < 300)) for d_, *_ in docs if d_ < 300]
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    everything = ids(docs)
    clean = c.drop_toxic(spark, docs, tables)
    assert clean.columns == docs.columns and ids(clean) == everything - set(range(200, 230))
    single = c.drop_near_duplicates(spark, docs, tables)
    assert single.columns == docs.columns and ids(single) == everything - {300, 301}
    apart = c.drop_contaminated(spark, docs, tables)
    assert apart.columns == docs.columns and ids(apart) == everything - {302}
    masked = c.mask_personal_data(spark, docs, tables)
    assert masked.columns == docs.columns and ids(masked) == everything
    texts = {r["doc_id"]: r for r in masked.collect()}
    assert "[EMAIL]" in texts[303]["text"] and "@" not in texts[303]["text"] and texts[303]["n_chars"] == len(texts[303]["text"])
    packed = c.pack(spark, docs, tables)
    assert ids(packed) == everything


def test_whole_pipeline(spark, tables):
    out = c.run(spark, tables)
    everything = ids(spark.read.parquet(f"{tables}/documents.parquet"))
    assert ids(out) == everything - set(range(200, 230)) - {300, 301, 302}
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


ODD = [(1, None), (2, ""), (3, " \n "), (4, "some words of a text that says little"), (4, "some words of a text that says little"), (4, "other words under the same number"), (None, "no number here"), (None, None), (5, "long text " * 30_000)]


def test_stages_of_odd_rows(spark, tables):
    """Nulls, empty and very long texts, repeated ids, clashing names, empty tables."""
    df = spark.createDataFrame([(d, t, None, "s", None, k, "x", 1.0, ["y"], 7) for k, (d, t) in enumerate(ODD)], "doc_id bigint, text string, lang string, source string, n_chars bigint, c0 int, rep string, score double, _words array<string>, set_id int")
    rows = lambda x: sorted(map(str, x.select("doc_id", "text", "c0").collect()))
    for name, stage in c.STAGES[:-1]:
        out, none = stage(spark, df, tables), stage(spark, df.limit(0), tables)
        assert out.columns == none.columns == df.columns and none.count() == 0, name
        # only one of two equal rows goes, and only among near duplicates
        want = df.filter("c0 <> 4") if name == "near_duplicates" else df
        assert rows(out) == rows(want), name
        # what a stage returns can be written and is the next one's input
        assert stage(spark, out, tables).count() == out.count(), name
    packed = c.pack(spark, df, tables)
    assert packed.filter("start = 0").count() == len(ODD) and c.pack(spark, df.limit(0), tables).count() == 0


def test_queries_are_registered():
    assert [q.split("_")[0] for q in sorted(QUERIES, key=lambda q: int(q.split("_")[0][2:]))] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)
