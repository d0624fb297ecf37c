"""Snapshot difference, piece codec and Merkle manifest, against brute force, plain SQL and the library itself."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
import tempfile
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import merkle, piece_codec, snapshot_diff

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROOT = Path(__file__).resolve().parent.parent.parent
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "Word\nword", "en", "", 9),
    (5, "Word\nword", "en", "a", 9),
    (5, "Word\nword", "en", "a", 9),
    (5, "other", None, "a", 5),
    (None, "no id here\nat all", "en", "a", 17),
    (None, "no id here\nat all", "en", "b", 17),
    (6, "x y\n" * 60_000, "en", "a", 240_000),
    (7, "ÄÖ ß é \U0001f600 中文 İ K </s> ▁ \0", "de", "é", 12),
]


def clashing(df):
    return df.withColumn("k", F.lit(1)).withColumn("key", F.lit("x")).withColumn("tie", F.lit(2)).withColumn("leaf", F.lit(3)).withColumn("ids", F.lit(4)).withColumn("content", F.lit(5)).withColumn("named", F.lit(6))


def as_text(rows):
    return sorted(map(str, map(tuple, rows)))


def many(n, seed, keys=None, hot=3):
    """Rows of which a third agree in text, lang and source."""
    rng = random.Random(seed)
    keys = keys or (lambda i: i)
    return [(keys(i), "hot\ntext" if i % hot == 0 else f"{rng.choice('abc')}\n{rng.randint(0, n // 4)}", rng.choice(["en", "de", None]) if i % hot else "en", "big" if i % hot == 0 else rng.choice(["s1", "s2", None, ""]), i) for i in range(n)]


# --- snapshot difference ---


def four(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


@pytest.mark.parametrize("rows", [ODD, many(400, 1), [(0, "a", "en", "s", 1)], []])
def test_snapshot_diff_equals_brute_force(spark, rows):
    docs = clashing(spark.createDataFrame(rows, DOCS))
    later = snapshot_diff.later_snapshot(docs)
    got = snapshot_diff.snapshot_diff(docs, clashing(later)).collect()
    assert as_text(got) == as_text(snapshot_diff.brute_force(four(docs), four(later)))


def test_snapshot_diff_of_unlike_tables(spark):
    """Repeated, null and foreign keys on either side, groups of equal content, one side empty."""
    rng = random.Random(5)
    make = lambda n: [(rng.choice([None, *range(40)]), rng.choice(["t", "u", None, "long " * 20]), rng.choice(["en", None]), rng.choice(["a", "b", None]), 0) for _ in range(n)]
    for a, b in ((make(150), make(200)), (make(30), []), ([], make(30))):
        old, new = spark.createDataFrame(a, DOCS), spark.createDataFrame(b, DOCS)
        got = snapshot_diff.snapshot_diff(old, new).collect()
        assert as_text(got) == as_text(snapshot_diff.brute_force(four(old), four(new)))


def test_content_pairs_run_against_each_other(spark):
    old = spark.createDataFrame([(1, "t", "en", "a", 0), (2, "t", "en", "b", 0), (3, "t", "en", "c", 0)], DOCS)
    new = spark.createDataFrame([(-1, "t", "en", "a", 0), (-5, "t", "en", "a", 0)], DOCS)
    got = {(r["old_key"], r["key"], r["op"], r["changed"]) for r in snapshot_diff.snapshot_diff(old, new).collect()}
    assert got == {(1, -1, "rekey", ""), (2, -5, "rekey", "source"), (3, 3, "delete", "")}


def test_filter_never_denies_a_key_it_holds(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    words = 5000 * snapshot_diff.BITS // 64 + 1
    filters = snapshot_diff.filter_words(rows, words)
    assert snapshot_diff.maybe_in(rows, filters, words).filter("not maybe").count() == 0
    strangers = spark.range(10_000, 30_000).withColumnRenamed("id", "k")
    assert snapshot_diff.maybe_in(strangers, filters, words).filter("maybe").count() < 0.06 * 20_000


def test_snapshot_diff_equals_sql(spark, tmp_path):
    rows = [r for r in many(300, 9) if r[0] is not None]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"SELECT key, old_key, op, changed, row_sha256 FROM ({snapshot_diff.oracle_sql()})").fetchall()
    assert as_text(snapshot_diff.snapshot_diff(docs, snapshot_diff.later_snapshot(docs)).collect()) == as_text(want)


def test_crc_in_sql():
    con = duckdb.connect()
    ids = [0, 7, 10, 255, 123456789012, -5]
    got = con.execute(f"WITH crc AS ({merkle.CRC_TABLE}) SELECT {merkle.CRC} FROM (SELECT unnest({ids}) AS doc_id), crc").fetchall()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) for i in ids]


# --- piece codec ---


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_equals_the_library(library):
    rng = random.Random(11)
    alphabet = "  \n\tabcdetheingor▁.,</s>[INST]éßЖ中梦\0　😀́İ0123"
    texts = ["", " ", "\n", "▁", "  a", " " * 5000, "a" * 3000, "the" * 500, "</s>", "\n\n a", "a\n", "\0"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    codec = piece_codec.Codec(MODEL, remember=500)
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        ids, sizes, wrong = piece_codec.encode_rows(codec, [t.encode() for t in part], True)
        assert not wrong.any()
        back = codec.decode(ids, sizes)
        for t, n, b in zip(part, np.cumsum(sizes).tolist(), back, strict=True):
            want = library.encode(t, add_eos=True)
            assert ids[n - len(want) : n].tolist() == want, t
            assert b.decode() == library.decode(want), t


def test_agenda_alone_equals_rows_abreast():
    v, rng = piece_codec.vocabulary(MODEL), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("theinga re") for _ in range(rng.randint(1, 30)))
        symbols = v.characters(np.array([ord(c) for c in text], np.int64))
        alone = piece_codec.agenda(v, symbols.tolist())
        together = piece_codec.abreast(v, np.append(symbols, [-1, -1])[None, :])[0]
        assert alone == [x for x in together.tolist() if x != -1]


def test_parts_give_the_ids_of_the_whole(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "PART_BYTES", 40)
    monkeypatch.setattr(piece_codec.cuts, "__defaults__", (40,))
    monkeypatch.setattr(piece_codec, "TOGETHER", 200)
    monkeypatch.setattr(piece_codec, "CHECKED_IDS", 16)
    rng, codec = random.Random(4), piece_codec.Codec(MODEL)
    for _ in range(60):
        t = "".join(rng.choice(["the ", "  ", "\n", "word", "中😀", "▁", " a b", "x" * 30]) for _ in range(100))
        ids, sizes, _ = piece_codec.encode_rows(codec, [t.encode()], False)
        assert ids.tolist() == library.encode(t)
        assert codec.agreed(ids, codec.decode(ids, sizes)[0]) == (library.decode(ids.tolist()).encode(), 0)


def test_codec_over_tables(spark, library):
    docs = clashing(spark.createDataFrame(ODD, DOCS))
    got = as_text(piece_codec.round_trip(docs, MODEL).collect())
    want = []
    for r in ODD:
        ids = library.encode(r[1] or "", add_eos=True)
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r[0], len(ids), h(" ".join(map(str, ids))), h(library.decode(ids)), 0, 0))
    assert got == as_text(want)
    assert piece_codec.round_trip(docs.limit(0), MODEL).count() == 0


def test_decode_takes_any_ids(spark, library):
    lists = [[2], [], None, [1, 264, 2], [230], [0, 264], [28705], [130, 231, 264]]
    got = {r["k"]: r["text"] for r in piece_codec.decode(spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>"), MODEL).collect()}
    assert got == {i: library.decode(x or []) for i, x in enumerate(lists)}


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(open(MODEL, "rb").read().replace(b"</s>", b"</t>", 1) + b"\x12\x02\x18\x01")  # model type: unigram
    with pytest.raises(ValueError):
        piece_codec.vocabulary(str(tmp_path / "m.model"))


def test_a_long_text_needs_memory_of_its_ids_only():
    """32 MB of text: beside the text (twice) and its ids (twice), little more than the parts that are encoded together."""
    code = """
import resource
from quern.llm import piece_codec
codec = piece_codec.Codec(%r)
piece_codec.encode_rows(codec, [b"warm up " * 100_000], True)
text = b"some words of a long line and more \\n" * 930_000
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
ids, _, _ = piece_codec.encode_rows(codec, [text], True)
print(len(ids), peak() - before, len(text) / 2**20)
"""
    out = subprocess.run([sys.executable, "-c", code % MODEL], capture_output=True, text=True, check=True, cwd=ROOT)
    n, grown, size = map(float, out.stdout.split())
    assert n > 930_000 and grown < 8 * n / 2**20 + 2 * size + 120


# --- Merkle manifest ---

TAMPERED = lambda k: k is not None and zlib.crc32(str(k).encode()) % 2 == 0


def five(rows):
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("rows", [ODD, many(500, 3), [(0, "a\nb", "en", "s", 1)], many(3, 1, hot=1), many(90, 2, lambda i: -i, hot=1)])
def test_manifest_equals_brute_force(spark, rows, levels):
    got = merkle.tamper_check(clashing(spark.createDataFrame(rows, DOCS)).drop("leaf"), levels).collect()
    assert as_text(got) == as_text(merkle.brute_force(five(rows), TAMPERED))


def test_manifest_of_many_groups_and_of_none(spark):
    rows = [(i, f"t\n{i}", "en", f"s{i % 130}", i) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    assert as_text(merkle.tamper_check(docs, 2).collect()) == as_text(merkle.brute_force(five(rows), TAMPERED))
    assert merkle.tamper_check(docs.limit(0)).collect() == []


def test_manifest_equals_sql(spark, tmp_path):
    docs = spark.createDataFrame(many(200, 8), DOCS)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.oracle_sql()})").fetchall()
    assert as_text(merkle.tamper_check(docs).collect()) == as_text(want)


def test_any_change_breaks_a_proof(spark):
    docs = spark.createDataFrame(many(60, 4), DOCS)
    proofs = merkle.manifest(docs)
    assert merkle.verified(proofs).filter("not verified").count() == 0
    swapped = proofs.withColumn("siblings", F.when(F.col("siblings") != "", F.reverse("siblings")).otherwise("siblings"))
    assert merkle.verified(swapped).filter("verified").count() == 0
    other = merkle.manifest(docs.withColumn("lang", F.when(F.col("doc_id") == 5, "xx").otherwise(F.col("lang"))))
    assert other.select("root").first() != proofs.select("root").first()


# --- token counts of long texts ---


def test_counts_of_parts_are_those_of_the_whole(library, monkeypatch):
    from quern.llm import token_counts

    monkeypatch.setattr(token_counts, "PART_BYTES", 60)
    rng, count = random.Random(6), token_counts.Counter(MODEL)
    texts = ["".join(rng.choice(["the ", "  ", "\n", "word", "中😀", " a b", "x" * 30, "▁" if k % 5 == 0 else "y"]) for _ in range(rng.randint(1, 120))) for k in range(300)] + ["\n" * 200, " " * 200, "x" * 500]
    assert count([t.encode() for t in texts]).tolist() == [len(library.encode(t)) for t in texts]


def test_counting_a_long_text_needs_little_memory():
    code = """
import resource
from quern.llm import token_counts
count = token_counts.Counter(%r)
count([b"warm up " * 100_000])
text = b"some words of a long line and more \\n" * 930_000
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
print(count([text])[0], peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code % MODEL], capture_output=True, text=True, check=True, cwd=ROOT)
    n, grown = map(float, out.stdout.split())
    assert n > 930_000 and grown < 60  # 32 MB of text


# --- a block of decontamination ---


def test_tables_of_a_full_block_are_small():
    """What a task holds of a block of windows of random words: less than 100 MB beside the library."""
    code = """
import os, pickle, random, sys
from quern.llm import decontamination as d
path = sys.argv[1]
if len(sys.argv) > 2:
    rng = random.Random(1)
    word = lambda: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 12)))
    rows, size = [], 0
    while size < d.BLOCK_BYTES:
        for w in d.windows_of(b" ".join(word() for _ in range(200))):
            rows.append({"window": w, "item_id": str(len(rows) // 188)})
            size += len(w) + 32
    with open(path, "wb") as f:
        pickle.dump(d._tables(rows), f, protocol=5)
else:
    held = lambda: int([x for x in open("/proc/self/status") if x.startswith("VmRSS")][0].split()[1]) / 1024
    before = held()
    with open(path, "rb") as f:
        tables = pickle.load(f)
    print(held() - before)
"""
    with tempfile.TemporaryDirectory() as folder:
        run = lambda *more: subprocess.run([sys.executable, "-c", code, f"{folder}/t", *more], capture_output=True, text=True, check=True, cwd=ROOT)
        run("write")
        assert float(run().stdout) < 100
