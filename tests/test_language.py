"""Languages by n-gram profiles: plain rules, held-out accuracy, and the learned profiles against SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import html, language

SF = "/root/testdata/sf0.01"


def plain_guess(text, profiles, most):
    """The same by definition, one text at a time."""
    padded = language._padded(text.strip()[: language.READ])
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                counts[g] += 1
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    own = sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]
    total = {lang: sum(abs(p[g] - k) if g in p else most for k, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(total.values())
    return next(iter(x for x in total if total[x] == best)) if own and list(total.values()).count(best) == 1 else None


def test_distances_are_those_of_the_definition():
    rows = []
    for lang in ("de", "en", "fr"):
        _, codes, rank = language.ranked([language.SAMPLES[lang]], 100)
        rows += [(lang, "".join(chr((c >> s) & 0x1FFFFF) for s in (42, 21, 0) if c >> s), r) for c, r in zip(codes.tolist(), rank.tolist(), strict=True)]
    profiles = {x: {g: r for y, g, r in rows if y == x} for x in ("de", "en", "fr")}
    model = language.Profiles.of(rows, 100)
    texts = [language.SAMPLES[x][a : a + 130] for x in language.SAMPLES for a in range(0, 600, 37)] + ["xyzq " * 20, "1234 " * 20]
    assert model.guess(texts) == [plain_guess(t, profiles, 100) for t in texts]
    assert model.guess(texts[:1]) == model.guess(texts)[:1]  # a text's answer does not depend on its batch


@pytest.mark.parametrize("text", [None, "", "short text", " " * 200, "12345 67890 " * 20, "!?;:" * 40])
def test_no_language(text):
    assert html.guess_language(text) is None


def test_sentences_that_no_profile_was_made_of():
    texts = {
        "de": "Nach dem Regen roch der Garten nach Erde, und die Kinder liefen barfuß durch das nasse Gras.",
        "en": "After the rain the garden smelled of earth, and the children ran barefoot through the wet grass.",
        "es": "Después de la lluvia el jardín olía a tierra, y los niños corrían descalzos por la hierba mojada.",
        "fr": "Après la pluie le jardin sentait la terre, et les enfants couraient pieds nus dans l'herbe mouillée.",
        "it": "Dopo la pioggia il giardino profumava di terra, e i bambini correvano scalzi nell'erba bagnata.",
        "nl": "Na de regen rook de tuin naar aarde, en de kinderen liepen op blote voeten door het natte gras.",
        "pt": "Depois da chuva o jardim cheirava a terra, e as crianças corriam descalças pela relva molhada.",
    }
    assert {k: html.guess_language(t) for k, t in texts.items()} == {k: k for k in texts}


def test_held_out_documents(spark):
    """Profiles of four fifths of the documents, the rest guessed; and by the built-in ones, which never saw any."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.learned(docs.filter(~held))
    got = docs.filter(held & (F.length(F.trim("text")) >= 50)).select("lang", language.guessed("text", model).alias("learned"), language.guessed("text").alias("plain")).collect()
    right = lambda c: sum(r[c] == r["lang"] for r in got) / len(got)
    assert len(got) > 150 and right("learned") > 0.97, right("learned")
    assert right("plain") > 0.9, right("plain")


def test_profiles_equal_sql(spark):
    from quern.plans import catalog

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(f"SELECT gram, language, rank FROM ({catalog.oracle_sql()['language_profiles']})").fetchall()
    got = catalog.queries()["language_profiles"](spark, "/root/testdata/sf0.001")
    assert sorted((r["gram"], r["language"], r["rank"]) for r in got.collect()) == sorted(want) and len(want) == 1200
