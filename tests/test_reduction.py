"""Trees of model calls, inventories in one go, views: against plain Python."""

from __future__ import annotations

import json
import random

import pytest

from quern.operators import inventory, retrieval
from quern.operators.reduction import reduced


def items(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 64, 130])
def test_a_tree_keeps_the_order(spark, n):
    calls = spark.sparkContext.accumulator(0)

    def combine(texts, last):
        calls.add(1)
        assert len(texts) <= 4 and sum(map(len, texts)) <= 400
        return ",".join(texts)[:100]

    got = reduced(items(spark, [f"{k}" for k in range(n)]), combine, "k", each=100, read=400, reply=100)
    want = ",".join(str(k) for k in range(n))
    assert got == (None if n == 0 else want if len(want) <= 25 else got) and (n == 0 or got[:20] == want[:20])
    if n in (9, 64):
        assert calls.value == {9: 3 + 1, 64: 16 + 4 + 1}[n]


def test_failed_calls_hand_their_texts_on(spark):
    def combine(texts, last):
        if not last:
            raise OSError("no model")
        return "|".join(texts)

    assert reduced(items(spark, list("abcdef")), combine, "k", each=10, read=20, reply=10) == "a\nb\nc\nd|e\nf"


def test_an_index_of_ten_thousand_articles(spark):
    """No call sees all lines, and every article's name reaches the page that is written last."""
    from pyspark.sql import functions as F

    from quern.plans.compile import written_index

    articles = spark.range(10_000).select(F.format_string("a%05d.md", "id").alias("name"), F.lit("# Title").alias("content"))
    clusters = spark.range(10_000).select(F.format_string("a%05d", "id").alias("slug"), F.format_string("Name %d", "id").alias("name"))
    live = spark.createDataFrame([("de",), ("de",), ("en",)], "language string")
    longest = spark.sparkContext.accumulator(0)

    def call(prompt, model, n):
        assert len(prompt) <= 81_000 and prompt.startswith("P\n\nSprache der Quellen: de\n\n")
        longest.add(len(prompt) > 20_000)
        lines = [x.split(" → ")[0].split("/")[-1].strip() for x in prompt.split("\n")[4:] if x.strip()]
        return f"{lines[0].split('-')[0]}-{lines[-1].split('-')[-1]} {sum(int(x.split(' ')[1]) if ' ' in x else 1 for x in lines)}"

    got = written_index(articles, clusters, live, call, "", "P")
    assert got.split(" ")[0] == "a00000-a09999" and longest.value == 0


def sequential(parts):
    """Merging one inventory after the other."""
    clusters, topics = {}, {}
    for part in parts:
        for c in part["clusters"]:
            if not c["slug"]:
                continue
            if c["slug"] in clusters:
                clusters[c["slug"]]["files"] = sorted({*clusters[c["slug"]]["files"], *c["files"]})
            else:
                clusters[c["slug"]] = dict(c)
        for t in part["main_topics"]:
            topics.setdefault(t.lower(), t)
    return [(c["slug"], c["name"], c["description"], c["files"]) for c in clusters.values()], list(topics.values())


def test_merging_equals_one_after_the_other(spark):
    rng = random.Random(1)
    for n in (0, 1, 25):
        parts = [{"ord": k, "domain": "d", "main_topics": [rng.choice(["Bau", "bau", "BAU", "Öl", "öl", f"t{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 4))], "clusters": [{"slug": rng.choice(["", "a", "b", f"s{rng.randint(0, 20)}"]), "name": f"n{k}{j}", "description": f"d{j}", "files": [f"f{rng.randint(0, 30)}" for _ in range(3)]} for j in range(rng.randint(0, 5))]} for k in range(n)]
        clusters, topics = inventory.merged_inventories(spark.createDataFrame(parts, inventory.PART))
        got = [(r["slug"], r["name"], r["description"], r["files"]) for r in clusters.orderBy("ord").collect()], [r["topic"] for r in topics.orderBy("ord").collect()]
        assert got == sequential(parts)


PAGES = [(f"d/{k:02d}.md", f"page {k} about {'rivers' if k % 3 else 'roads'}") for k in range(10)]


def model(prompt, model, n):
    """One cluster for each batch; merging unites them by hand."""
    if prompt.startswith("MERGE"):
        found = [json.loads(x) for x in prompt.removeprefix("MERGE").split("\n\n---\n\n")]
        return json.dumps({"main_topics": ["All"], "clusters": [{"slug": "all", "name": "All", "description": "", "files": sorted(f for i in found for c in i["clusters"] for f in c["files"])}]})
    names = [x[4:] for x in prompt.split("\n") if x.startswith("### ")]
    return json.dumps({"main_topics": ["T"], "clusters": [{"slug": f"s{len(names)}", "name": "N", "description": "", "files": names}]})


def test_an_inventory_in_one_go(spark):
    pages = spark.createDataFrame(PAGES, "rel string, content string")
    run = lambda call, batch: [[tuple(r) for r in df.orderBy("ord").drop("ord").collect()] for df in inventory.one_shot(pages, call, "", "FIND", "MERGE", batch)]
    names = [p for p, _ in PAGES]
    assert run(model, 30) == [[("s10", "N", "", names)], [("T",)]]
    assert run(model, 4) == [[("all", "All", "", names)], [("All",)]]

    def no_merge(prompt, *more):
        return "sorry" if prompt.startswith("MERGE") else model(prompt, *more)

    assert run(no_merge, 4) == [[("s4", "N", "", names[:8]), ("s2", "N", "", names[8:])], [("T",)]]
    assert run(lambda *_: "sorry", 4) == [[("allgemein", "Allgemein", "Alle Inhalte", names)], [("Allgemein",)]]


def test_chats_newest_first(spark):
    rows = [("a", "1", "t", "2026-01-01"), ("a", "2", "t", "2026-01-03"), ("a", "3", "t", None), ("b", "4", "t", "2025"), ("a", None, "t", "2027"), ("a", "5", None, "2027"), (None, "6", "t", "x")]
    chats = spark.createDataFrame(rows, "bucket string, id string, title string, updated string")
    get = lambda b: [(r["bucket"], r["id"], r["place"]) for r in retrieval.listed_chats(chats, b).orderBy("bucket", "place").collect()]
    assert get("a") == [("a", "2", 0), ("a", "1", 1), ("a", "3", 2)]
    assert get(None) == [("", "6", 0), ("a", "2", 0), ("a", "1", 1), ("a", "3", 2), ("b", "4", 0)] and get("none") == []


def test_stats_of_a_view(spark):
    pages = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y"), ("4", None)], "rel string, domain string")
    articles = spark.createDataFrame([("a.md", ""), ("b.md", ""), ("c.md", ""), ("_lint-report.md", "# R\n- one hint\n-x\n - two hints\n- a\n" + "- more\n" * 9)], "name string, content string")
    sources = spark.createDataFrame([("a.md", ["1", "2"]), ("b.md", ["3"]), ("c.md", ["9"])], "name string, sources array<string>")
    whole, view = retrieval.stats_view(pages, articles, sources, None, "01.01.2026").first(), retrieval.stats_view(pages, articles, sources, ["x"]).first()
    assert (whole["raw_count"], whole["article_count"], whole["domains"], whole["lint_hints"], whole["compiled"]) == (4, 3, ["x", "y"], ["one hint", "two hints", "more", "more", "more"], "01.01.2026")
    assert [tuple(a) for a in whole["articles"]] == [("a.md", ["x", "y"]), ("b.md", ["y"]), ("c.md", [])]
    assert (view["raw_count"], view["article_count"], view["domains"], view["lint_hints"]) == (1, 1, ["x"], [])
    assert retrieval.stats_view(pages.limit(0), articles.limit(0), sources.limit(0)).first()["raw_count"] == 0


def test_torn_sitemaps_hold_nothing():
    import gzip

    from quern.sources.sitemap import parse, unpacked

    whole = b"<urlset><url><loc>http://a/1</loc></url></urlset>" * 1
    packed = gzip.compress(whole)
    assert parse(unpacked(packed)) == parse(unpacked(packed, "http://a/s.xml.gz")) == parse(unpacked(whole)) == ("urlset", ["http://a/1"])
    assert parse(unpacked(packed[:-9])) == parse(unpacked(packed[:20])) == parse(unpacked(b"plain", "http://a/s.xml.GZ?x=1")) == ("", [])


def test_a_long_listing_is_routed_in_parts(spark):
    from pyspark.sql import functions as F

    listing = spark.range(3000).select(F.format_string("a%04d.md", "id").alias("name"), F.when(F.col("id") == 77, F.array(F.lit("Rhein"))).otherwise(F.array()).alias("entities"))
    calls = spark.sparkContext.accumulator(0)

    def call(messages):
        calls.add(1)
        text = messages[0]["content"]
        assert len(text) <= 5300 and text.startswith("ROUTE\n\nWo?\n\n")
        names = [x.split(" ")[1] for x in text.split("\n") if x.startswith("- ")]
        return ", ".join(n for n in names if n in ("a0077.md", "a2999.md")) or "none"

    assert retrieval.routed_reply("Wo?", listing, call, "ROUTE", read=5000) == "a0077.md, a2999.md" and calls.value > 100
    calls2 = []
    short = listing.filter("name < 'a0003' or name = 'a0077.md'")
    assert retrieval.routed_reply("Wo?", short, lambda m: calls2.append(m[0]["content"]) or "x") == "x"
    assert calls2 == ["Wo?\n\n- a0000.md\n- a0001.md\n- a0002.md\n- a0077.md  (Entitäten: Rhein)"]
