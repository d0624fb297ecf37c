"""Operators that learn from or compare a corpus: brute force, held-out accuracy, planted cases."""

from __future__ import annotations

import random

import pytest

from quern.llm import language_id, minhash, toxicity

SF = "/root/testdata/sf0.01"


# --- near duplicates ---


def corpus(rng):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 9)):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            rows.append(" ".join(w))
    rows += [rows[0]] * 5 + [rows[0].upper(), None, "", "  ", "one", "ONE", "one two", "one two", "one two three"]
    rng.shuffle(rows)
    return [(10 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_groups_equal_brute_force(spark, seed, width, percent):
    rows = corpus(random.Random(seed))
    got = grouped(spark, rows, width, percent)
    assert got == wanted(rows, width, percent)
    assert len({c for _, _, c in got}) < len(rows) - 10


def grouped(spark, rows, width, percent):
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width, percent).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)


def wanted(rows, width, percent):
    return sorted((d, n, c) for (d, _), (n, c) in zip(rows, minhash.brute_force(rows, width, percent), strict=True))


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_with_repeated_ids_equal_brute_force(spark, seed):
    """Rows that share a doc_id and have different texts: every text links what is near it."""
    rng = random.Random(seed)
    rows = [(d // rng.choice([1, 10, 60]), t) for d, t in corpus(rng)]
    assert len({d for d, _ in rows}) < len(rows) - 5
    assert grouped(spark, rows, 3, 85) == wanted(rows, 3, 85)


def test_both_texts_of_one_id_link(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(7, a), (7, b), (9, a + " more"), (11, b + " more"), (12, "none of this at all")]
    assert {(d, c) for d, _, c in grouped(spark, rows, 3, 85)} == {(7, 7), (9, 7), (11, 7), (12, 12)}
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate([*rows, rows[0], (5, b)])], "doc_id bigint, text string, place int")
    # both texts of 7 are of different groups; the copy of b under a lower id stands for its group
    assert sorted((r["doc_id"], r["text"], r["place"]) for r in minhash.keep_one(df, 3, 85).collect()) == sorted([(7, a, 0), (5, b, 6), (12, rows[4][1], 4)])


def test_tables_in_between_are_deleted(spark):
    import os

    from quern.state import shared_dir

    top = shared_dir(spark).removeprefix("file:") + "/quern"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    out = minhash.near_duplicates(spark.createDataFrame(corpus(random.Random(5)), "doc_id bigint, text string"), 3, 85)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before}
    assert left <= {"prepared", "of_set"}, left
    assert out.count() > 0


def test_near_copies_just_below_the_threshold(spark):
    """A family whose members are linked through a few typical ones only: nothing may be lost."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for d in range(160):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 12)):
            w[k] = f"n{rng.randrange(3000)}"
        rows.append((d, " ".join(w)))
    want = wanted(rows, 3, 85)
    assert grouped(spark, rows, 3, 85) == want and 1 < len({c for _, _, c in want}) < 160


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d"), (None, None), (1, None), (2, ""), (7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (8, "x " * 50_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, rep string, component bigint")
    out = minhash.near_duplicates(df, 3, 85).collect()
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(None, None, True), (1, 1, True), (2, 2, True), (7, 7, True), (9, 7, False), (8, 8, True)}
    kept = minhash.keep_one(df, 3, 85)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "7", "8", "None", "None"]
    assert minhash.near_duplicates(df.limit(0), 3, 85).count() == 0 and minhash.keep_one(df.limit(0)).count() == 0


def test_banding_meets_its_promise():
    for t in (0.7, 0.8, 0.85, 0.95):
        rows, bands = minhash.banding(t)
        assert (1 - t**rows) ** bands <= minhash.MISS and rows * bands <= minhash.HASHES


# --- toxicity ---


def toxic_rows(rng, n, clean_words=600):
    bad = ["idiot", "moron", "clownish", "clownery"]
    docs, labels = [], []
    for d in range(n):
        w = [f"word{rng.randrange(clean_words)}" for _ in range(rng.randint(3, 60))]
        y = int(rng.random() < 0.2)
        for _ in range(y * rng.randint(1, 3)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((d, " ".join(w)))
        labels.append((d, y))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows(random.Random(1), 900)
    extra = [(5000, None), (5001, ""), (5002, "IDIOT!! " + "fine words " * 3000), (5002, "twice"), (None, "no id")]
    df = spark.createDataFrame(docs + extra, "doc_id bigint, text string").selectExpr("*", "1 AS score", "'x' AS predicted")
    lab = spark.createDataFrame([*[(d, 1, y) for d, y in labels], (3, 1, None), (None, 1, 1), (99999, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.toxicity(df, lab).collect()
    assert len(out) == len(docs) + len(extra)
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in out if r["doc_id"] != 5002}
    assert by[5000]["predicted"] == by[5001]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in out)
    assert max(r["score"] for r in out if r["doc_id"] == 5002) > 0.5
    kept = toxicity.keep_clean(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


def test_toxicity_learns_only_from_its_folds(spark):
    docs, labels = toxic_rows(random.Random(2), 400)
    from zlib import crc32

    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    fair = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    lied = toxicity.toxicity(df, spark.createDataFrame([(d, y if crc32(str(d).encode()) % 5 else 1 - y) for d, y in labels], "doc_id bigint, toxic int"))
    assert sorted(fair.collect()) == sorted(lied.collect())


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.toxicity(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(df, one).collect())
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    import numpy as np

    rng = np.random.default_rng(0)
    n = 6000
    y = rng.random(n) < 0.3
    fire = lambda one, zero: rng.random(n) < np.where(y, one, zero)
    votes = [fire(0.6, 0.02), fire(0.3, 0.01), fire(0.3, 0.2), fire(0.05, 0.5)]
    votes.append(np.where(rng.random(n) < 0.9, votes[0], fire(0.3, 0.05)))  # hardly more than a copy of the first
    votes = np.array(votes).T.astype(np.uint8)
    seed = np.where(rng.random(n) < 0.05, ~y, y).astype(float)
    post, a, b, parent = toxicity.label_model(votes, seed)
    for k in range(5):
        assert abs(a[k] - votes[y, k].mean()) < 0.05 and abs(b[k] - votes[~y, k].mean()) < 0.05
    assert {(k, int(p)) for k, p in enumerate(parent) if p >= 0} in ({(4, 0)}, {(0, 4)})
    assert ((post > 0.5) == y).mean() >= ((seed > 0.5) == y).mean()
    # the copy adds next to nothing: without it the classes are nearly the same
    alone = toxicity.label_model(votes[:, :4], seed)[0]
    assert np.abs(post - alone).mean() < 0.01
    nothing = toxicity.label_model(np.zeros((0, 0), np.uint8), np.zeros(0))
    assert len(nothing[0]) == 0


def test_forest_equals_the_best_of_all_forests():
    """Greatest mutual information within the classes, against trying all parents of four voters."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    n = 1500
    y = rng.random(n) < 0.4
    v = [rng.random(n) < np.where(y, 0.5, 0.1)]
    for k in (0, 0, 1):
        v.append(np.where(rng.random(n) < 0.6, v[k], rng.random(n) < 0.3))
    x = np.array(v).T.astype(np.uint8)

    def information(i, j):
        total = 0.0
        for side in (y, ~y):
            m = side.sum()
            for p, q in itertools.product((0, 1), repeat=2):
                r = ((x[:, i] == p) & (x[:, j] == q) & side).sum()
                total += 2 * r * np.log(r * m / (((x[:, i] == p) & side).sum() * ((x[:, j] == q) & side).sum()))
        return total

    gain = {(i, j): information(i, j) for i in range(4) for j in range(i + 1, 4)}
    acyclic = [e for e in itertools.combinations(gain, 3) if len({z for i, j in e for z in (i, j)}) == 4]
    best = max(acyclic, key=lambda e: sum(gain[z] for z in e))
    parent = toxicity.tree(x, y.astype(float))
    assert {tuple(sorted((k, int(p)))) for k, p in enumerate(parent) if p >= 0} == set(best)


def test_regression_is_at_its_optimum():
    import numpy as np

    rng = np.random.default_rng(6)
    x = (rng.random((400, 6)) < 0.3).astype(np.float32)
    post = 1 / (1 + np.exp(-(x @ np.array([2, 1, 0, -1, 0.5, 0]) - 0.5)))
    w, bias = toxicity._regression(x, post, ridge=1e-2)
    weight = np.where(post > 0.5, 0.5 * 400 / (post > 0.5).sum(), 0.5 * 400 / (post <= 0.5).sum())

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - post * z)).sum() + 0.5 * 0.1 * (w * w).sum() + 0.5e-3 * b * b

    assert all(loss(w, bias) <= loss(w + 0.05 * rng.normal(size=6), bias + 0.05 * rng.normal()) + 1e-6 for _ in range(300))


def test_fixed_patterns_equal_plain_rules():
    import re

    rng = random.Random(15)
    pool = ["you", "idiot", "IDIOT", "the", "THE", "please", "soooo", "what??", "no!", "yes!!", "du", "trottel", "müll", "usted", "basura,", "ABCDEFGHIJ KLMNOPQRST", "aaa", "x"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(600)] + ["", "!", "!!"]
    found, row = toxicity.patterns([t.encode() for t in texts])
    got = [set() for _ in texts]
    for p, r in zip(found.tolist(), row.tolist(), strict=True):
        if p < len(toxicity.FIXED):
            got[r].add(toxicity.FIXED[p])
    for t, g in zip(texts, got, strict=True):
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())
        listed = [k for k, x in enumerate(w) if x in toxicity.INSULTS]
        you = [k for k, x in enumerate(w) if x in toxicity.SECOND_PERSON]
        ups, lows = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
        rules = [
            bool(listed), len(listed) > 1, any(-4 <= u - k <= 2 and u != k for k in listed for u in you), ups + lows >= 20 and ups >= 0.6 * (ups + lows),
            bool(re.search("[!?][!?]", t)), bool(re.search(r"([A-Za-z])\1\1\1", t)), any(x in toxicity.POLITE for x in w),
        ]
        rules.append(not any(rules[:6]))
        assert g == {name for name, on in zip(toxicity.FIXED, rules, strict=True) if on}, t


def test_words_of_both_classes_vote(spark):
    """A made-up word of the toxic class and one of the clean class, neither on a list, both get weight; there is no cap on voters."""
    rng = random.Random(16)
    docs, labels = [], []
    for d in range(1500):
        y = int(rng.random() < 0.3)
        w = [f"w{rng.randrange(300)}" for _ in range(30)] + [f"{'bad' if y else 'good'}{rng.randrange(700 if y else 3)}x" for _ in range(25 if y else 1)]
        docs.append((d, " ".join(w)))
        labels.append((d, y))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    signs = [(one > zero) for p, one, zero, _ in model.voters if p >= len(toxicity.FIXED)]
    assert sum(signs) > 600 and signs.count(False) >= 2


# --- languages ---


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.language_id(docs)
    r = out.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("count(*) AS n", "avg(cast(lang = lang_pred AS int)) AS right").first()
    assert r["n"] > 100 and r["right"] > 0.95
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat and the dog went home", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, None, "en"), (5, "", None), (6, "123 !?", "de"), (7, "中文字", None), (None, "the house", "en"), (8, "the end " * 20_000, "en"), (8, "the end", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS score")
    out = language_id.language_id(df).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by[4] == by[5] == by[6] == "und" and by[7] != "und"
    bare = df.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in language_id.language_id(bare).collect()} == {"und"}
    assert language_id.language_id(df.limit(0)).count() == 0


def test_families():
    assert language_id.family("de-AT") == language_id.family("en") == "germanic" and language_id.family("fr") != language_id.family("xx")


def test_one_machine_for_each_pair_of_relatives():
    """Four related languages: six machines, each trained on two; their votes equal a naive count."""
    import numpy as np

    rng = np.random.default_rng(3)
    langs = ["de", "en", "nl", "sv", "fr"]
    centre = np.abs(rng.normal(size=(5, 40)))
    of = rng.integers(0, 5, 400)
    x = np.abs(centre[of] + 0.6 * rng.normal(size=(400, 40))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language_id.fit_features(x, [langs[k] for k in of])
    f = model.families.index("germanic")
    assert model.members[f] == ["de", "en", "nl", "sv"] and model.pairs[f].shape == (6, 41) and model.pairs[1 - f].shape == (0, 41)
    one = np.flatnonzero((of == 0) | (of == 2))
    y = np.where(of[one] == 0, 1, -1).astype(np.float32)
    order = np.argsort(-y, kind="stable")
    assert np.allclose(model.pairs[f][1], language_id.svm(x[one][order], y[order]))
    best, share = model._vote(x, f)
    for row, b in zip(x, best, strict=True):
        votes, sums, k = [0] * 4, [0.0] * 4, 0
        for i in range(4):
            for j in range(i + 1, 4):
                m = float(model.pairs[f][k][:-1] @ row + model.pairs[f][k][-1])
                votes[i if m >= 0 else j] += 1
                sums[i] += m
                sums[j] -= m
                k += 1
        assert (votes[b], round(sums[b], 4)) == max((v, round(z, 4)) for v, z in zip(votes, sums, strict=True))
    assert ((share >= 0) & (share <= 1)).all()
    right = best == np.array([model.members[f].index(langs[k]) if langs[k] in model.members[f] else -1 for k in of])
    assert right[of < 4].mean() > 0.9


def test_machines_equal_another_fit():
    """The machine minimises its loss: no random step around it is better."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=120) > 0, 1, -1).astype(np.float32)
    w = language_id.svm(x, y, ridge=1e-2, rounds=3000)

    def loss(w):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2
        return sum(0.5 * slack[y == s].mean() for s in (1, -1)) + 0.5e-2 * (w * w).sum()

    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=9)) + 1e-6 for _ in range(300))


def test_samples_keep_rare_values_whole(spark):
    from quern.llm._sample import by_hash, shares

    assert shares({"a": 10_000, "b": 50, "c": 5}, 600, 200) == {"a": 145 / 10_000, "b": 1.0, "c": 1.0}
    assert shares({"a": 10_000, "b": 5}, 600, 2400) == {"a": 0.06, "b": 1.0} and shares({}, 1, 1) == {}
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id < 40 THEN concat('rare', id % 4) ELSE concat('l', id % 10) END AS lang")
    got = {r["lang"]: r["count"] for r in by_hash(df, "lang", 600, 1000).groupBy("lang").count().collect()}
    assert sum(got.values()) <= 1000 and [got[f"rare{k}"] for k in range(4)] == [10] * 4 and all(60 < got[f"l{k}"] < 140 for k in range(10))
    assert by_hash(df.limit(0), "lang", 5, 9).count() == 0
