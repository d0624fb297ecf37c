"""MinHash near-duplicates: universal hash minima, banding, verified links, connected components.

Texts with equal shingle sets count as one: a set is named by 128 bits of it and numbered, whatever doc_ids have it. Banded
minima propose candidates; compact signatures discard hopeless ones; every link is confirmed on full sets. First
each set is compared with the set it shares most bands with among the least of its bands, then with the most typical
sets of its bands. Sets that share a band but whose links do not lead to one set yet are
paired by their rarest shingles: two sets can only be linked if the first of their common shingles, in the order of
frequency, leaves room for enough more in both. That bound is exact, so no link is given up, and it leaves few pairs even
of thousands of near copies just below the threshold.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._bytes import RangeHash, class_table, joined, mix, schema, slices, texts, words
from quern.operators.components import components
from quern.state import cut, forget

HASHES = 144
#: Chance that a pair exactly at the threshold shares no band.
MISS = 2e-5

_INSIDE = ~class_table(bytes([0x20, *range(0x09, 0x0E)]))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_K = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(7777)) >> np.uint64(32)).astype(np.uint32)


def banding(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands that lose a pair at the threshold with chance ``miss`` at most."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if (1 - threshold**rows) ** bands <= miss:
            return rows, bands
    return 1, hashes


def shingle_sets(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows end to end, and the n + 1 offsets."""
    data, starts = joined(rows, b" ")
    data = _LOWER[data]
    begin, end = words(data, _INSIDE)
    at = np.searchsorted(begin, starts)  # first word of each row
    h = RangeHash(data)(begin, end) if len(begin) else np.zeros(0, np.uint64)
    n = len(h)
    m = max(n - width + 1, 0)  # a batch may hold fewer words than a shingle
    full = np.zeros(m, np.uint64)
    for i in range(width):
        full += h[i : m + i] * _K[i]
    full = mix(full)
    sets, offsets = [], np.zeros(len(rows) + 1, np.int64)
    for r in range(len(rows)):
        a, b = int(at[r]), int(at[r + 1])
        if b - a >= width:
            x = full[a : b - width + 1].copy()
            x.sort()
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif b > a:
            x = mix((h[a:b] * _K[100 : 100 + b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            x = full[:0]
        sets.append(x)
        offsets[r + 1] = offsets[r] + len(x)
    return np.concatenate(sets) if sets else full[:0], offsets


def signatures(sets: np.ndarray, offsets: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys [row, band], low 16 bits of the minima [row, hash]) of non-empty sets."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    at = offsets[:-1]
    minima = np.empty((rows * bands, len(at)), np.uint32)
    v = np.empty_like(x)
    for j in range(rows * bands):
        np.multiply(x, _A[j], out=v)
        np.add(v, _B[j], out=v)
        minima[j] = np.minimum.reduceat(v, at)
    key = np.zeros((bands, len(at)), np.uint64)
    for j in range(rows):
        key += (minima[j::rows].astype(np.uint64) + np.uint64(1)) * _K[200 + j]
    key = mix(key + (np.arange(1, bands + 1, dtype=np.uint64) * _K[300])[:, None])
    return key.T.copy(), (minima & np.uint32(0xFFFF)).astype(np.uint16).T.copy()


def set_names(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two columns; zero for an empty one."""
    h1, h2 = (np.zeros(len(offsets) - 1, np.uint64) for _ in range(2))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        h1[full] = np.add.reduceat(sets, offsets[full])
        h2[full] = np.add.reduceat(mix(sets ^ _K[7]), offsets[full])
    return h1.view(np.int64), h2.view(np.int64)


def _prepared(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """doc_id, th (hash of the text), n, h1, h2 (the name of the set), keys (of bands), sig."""

    def run(batches):
        for batch in slices(batches, most=1 << 20):
            sets, offsets = shingle_sets(texts(batch), width)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            h1, h2 = set_names(sets, offsets)
            keys: list = [None] * len(n)
            sigs: list = [None] * len(n)
            if len(full):
                key, sig = signatures(sets, np.append(offsets[full], offsets[-1]), rows, bands)
                key = key.view(np.int64)
                for k, i in enumerate(full.tolist()):
                    keys[i], sigs[i] = key[k], sig[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "th", "n", "h1", "h2", "keys", "sig"]
            )

    return docs.mapInArrow(run, schema(docs, ["doc_id", "th"], "n bigint, h1 bigint, h2 bigint, keys array<bigint>, sig binary"))


def _set_table(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set_id, hashes: the full sets of ``wanted`` (set_id, rep, rep_th, h1, h2), each from the text that stands for it."""

    def run(batches):
        for batch in slices(batches, most=1 << 20):
            sets, offsets = shingle_sets(texts(batch), width)
            h1, h2 = set_names(sets, offsets)
            # two texts of one doc_id and one hash are told apart by their sets
            same = (h1 == np.asarray(batch.column(1))) & (h2 == np.asarray(batch.column(2)))
            hashes = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes], ["set_id", "hashes"]).filter(pa.array(same))

    chosen = docs.join(wanted, (docs["doc_id"] == wanted["rep"]) & (docs["th"] == wanted["rep_th"])).select("set_id", "h1", "h2", "text")
    return chosen.mapInArrow(run, "set_id bigint, hashes array<bigint>").dropDuplicates(["set_id"])


def _beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    one, two = (table.select(F.col("set_id").alias(k), F.col(value).alias(f"{k}_{value}")) for k in ("u", "v"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", f"u_{value}", f"v_{value}")


def _likely(pairs: DataFrame, sig: DataFrame, percent: int, hashes: int) -> DataFrame:
    """The pairs whose signatures agree as often as a link's do, less five standard deviations."""
    t = percent / 100
    least = t - 5 * math.sqrt(t * (1 - t) / hashes)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= least))

    return _beside(pairs, sig, "sig").mapInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links, judged on full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                lo, hi = sorted((len(x), len(y)))
                if 100 * lo < percent * hi:
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (lo + hi - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, sets, "hashes").mapInArrow(run, "u bigint, v bigint")


def _ranked(some: DataFrame, sets: DataFrame, percent: int, table=cut) -> DataFrame:
    """set_id, n, c, share (of shingles no other of these sets has), prefix: (place, token) of shared ones among the rarest.

    Shingles are ordered by the number of sets that have them. A link needs percent / 100 of a set's shingles in common, so
    a common one lies among its first n - ceil(percent * n / 100) + 1, and a set with more of its own than that has no link.
    """
    chosen = table(some.join(sets, "set_id"), "chosen")
    tokens = chosen.select("set_id", "n", "c", F.explode("hashes").alias("token"))
    often = table(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    rare = tokens.join(often, "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    # as many shingles as a text has, no more
    lists = rare.groupBy("set_id").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.count_if(F.col("df") == 1).alias("own"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)).cast("bigint") + 1
    head = F.transform(F.slice("t", F.lit(1), length.cast("int")), lambda x, i: F.struct(i.cast("bigint").alias("place"), x["df"].alias("df"), x["token"].alias("token")))
    linkable = lists.filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    return linkable.select("set_id", "n", "c", (F.col("own") / F.col("n")).alias("share"), F.filter(head, lambda x: x["df"] > 1).alias("prefix"))


def _within_bound(ranked: DataFrame, label2: DataFrame, percent: int, table=cut) -> DataFrame:
    """Pairs (u, v) of different labels that share a shingle which leaves room for a link.

    From common shingles at places i and j on, at most min(n - i, m - j) are common; a link of sets of n and m takes
    percent * (n + m) / (100 + percent). Of each shingle only sets outside its most frequent label are looked up among
    all its sets.
    """
    named = ranked.join(label2, ranked["set_id"] == label2["u"], "left").select("set_id", "n", F.coalesce("v", "set_id").alias("c"), F.inline("prefix")).drop("df")
    named = table(named, "prefixes")
    of = named.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "c"))["c"].alias("major"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = table(named.join(table(of.select("token", "major"), "majors"), "token"), "mixed")
    one = mixed.filter("c <> major").drop("major")
    two = mixed.select("token", F.col("set_id").alias("set2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("place").alias("place2"))
    room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    found = one.join(two, "token").filter("c <> c2").filter(room)
    return found.select(F.least("set_id", "set2").alias("u"), F.greatest("set_id", "set2").alias("v")).distinct()


#: Rows of an Arrow batch: a pair of full sets has some ten kilobytes, of long texts far more.
BATCH_ROWS = 200
#: What a task that writes a shuffled table reads at least: some thirty tables are written, most of them small.
TASK_BYTES = 8 << 20


@contextmanager
def _settings(spark: SparkSession):
    """Small Arrow batches and few small files for the jobs run inside; the session's own settings afterwards."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.adaptive.coalescePartitions.minPartitionSize": f"{TASK_BYTES}b"}
    was = {name: spark.conf.get(name) for name in ours}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered; the set of a text is its distinct ``width``-word shingles,
    or its whole sequence as one when it is shorter. Links: 100 * intersection >= ``percent`` * union. component_id is the
    smallest doc_id reachable, kept says that the row has it. Null, empty and blank texts have an empty set and stay alone. A row
    without doc_id cannot be named by a group: it stays alone with a null component_id and is kept. Rows that repeat
    a doc_id get one result each; those with words are linked by that id, whatever their texts: each of their texts links what is
    near it. Ties and other columns have no influence; an empty table gives no rows.
    """
    # every job with Python in it runs before this returns: the result only joins written tables
    with _settings(docs.sparkSession):
        rows, sets, links = _linked(_plain(docs, id_col, text_col), width, percent)
    named = rows.filter("n > 0 and doc_id is not null").select("doc_id", "n", "h1", "h2")
    ends = [f(F.col(c)).alias(f"{k}{c}") for c in ("h1", "h2") for k, f in (("lo", F.min), ("hi", F.max))]
    several = named.groupBy("doc_id").agg(*ends).filter("loh1 < hih1 or loh2 < hih2").select("doc_id")
    several = cut(named.join(several, "doc_id", "left_semi").join(sets, ["h1", "h2"]).select("doc_id", "set_id").distinct(), "several")
    hub = several.groupBy("doc_id").agg(F.min("set_id").alias("u"))
    by_id = several.join(hub, "doc_id").filter("set_id <> u").select("u", F.col("set_id").alias("v")).distinct()
    whole = components(links.unionByName(by_id))
    # the least set of a component has its least doc_id
    of_whole = whole.join(sets.select(F.col("set_id").alias("component"), F.col("rep").alias("component_id")), "component").select(F.col("node").alias("set_id"), "component_id")
    of_set = cut(sets.select("set_id", "rep", "h1", "h2").join(of_whole, "set_id", "left").select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id")), "of_set")
    for table in (several, links, whole, sets):
        forget(table)
    grouped = named.join(of_set, ["h1", "h2"]).select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = grouped.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: the rows, the sets, and links between sets that connect all that similarity connects.

    rows: doc_id, th, n, h1, h2 (and more). sets: set_id (rising with rep), h1, h2, rep (the least doc_id that has the set), rep_th
    (the text of it that stands for the set). links: u, v, numbers of sets. All other tables are deleted.
    """
    spent: list[DataFrame] = []

    def table(df: DataFrame, name: str) -> DataFrame:
        spent.append(cut(df, name))
        return spent[-1]

    each, bands = banding(percent / 100)
    every = cut(_prepared(docs, width, each, bands), "prepared")
    named = every.filter("n > 0 and doc_id is not null")
    # numbers rise with the least doc_id of a set; they are given once, when the table is written
    classes = table(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")).sort("rep").withColumn("set_id", F.monotonically_increasing_id()), "classes")
    first_rows = named.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "h1", "h2"]).dropDuplicates(["rep", "h1", "h2"])
    sig = table(first_rows.select("set_id", "rep", F.col("th").alias("rep_th"), "n", "h1", "h2", "keys", "sig"), "sigs")
    in_bands = sig.select("set_id", "n", F.explode("keys").alias("band"))
    ends = table(in_bands.groupBy("band").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo < hi").select("band", "lo"), "bands")
    shared = table(in_bands.join(ends, "band"), "shared")
    wanted = sig.select("set_id", "rep", "rep_th", "h1", "h2").join(shared.select("set_id").distinct(), "set_id", "left_semi")
    sets = table(_set_table(docs, wanted, width), "sets")

    # first: of the least sets of its bands, the one most bands name
    hubs = shared.filter("set_id <> lo").groupBy("set_id", F.col("lo").alias("hub")).count()
    first = hubs.groupBy("set_id").agg(F.max(F.struct("count", (-F.col("hub")).alias("hub"))).alias("best")).select(F.col("set_id").alias("u"), (-F.col("best.hub")).alias("v"))
    first = table(_likely(table(first, "first"), sig, percent, each * bands), "likely")
    links = table(_verified(first, sets, percent), "links")
    # where a set's links lead in two steps; any label that only linked sets share would do
    onward = links.select(F.col("u").alias("v"), F.col("v").alias("w"))
    label = table(links.join(onward, "v", "left").select(F.col("u").alias("set_id"), F.coalesce("w", "v").alias("c")), "label")

    # then: sets that share a band with a set of another label, and how frequent their shingles are among them
    apart = table(shared.select("band", "set_id", "n").join(label, "set_id", "left").withColumn("c", F.coalesce("c", "set_id")), "apart")
    mixed = table(apart.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("band"), "mixed")
    left = table(apart.join(mixed, "band"), "left")
    ranked = table(_ranked(left.select("set_id", "n", "c").distinct(), sets, percent, table), "ranked")

    # the most typical set of a band is the one with the smallest share of shingles of its own
    typical = left.select("band", "set_id").join(ranked.select("set_id", "c", "share"), "set_id")
    heads = table(typical.groupBy("band").agg(F.min(F.struct("share", F.col("set_id").alias("hub"), F.col("c").alias("hub_c"))).alias("h")).select("band", "h.hub", "h.hub_c", F.col("h.share").alias("hub_share")), "heads")
    to_heads = typical.join(heads, "band").filter("c <> hub_c").groupBy("set_id", "hub").agg(F.min("hub_share").alias("hub_share"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("hub_share", "hub"))), 1, 2)  # at most one entry per band
    second = table(to_heads.groupBy("set_id").agg(best.alias("best")).select(F.col("set_id").alias("u"), F.explode("best.hub").alias("v")), "second")
    links2 = table(_verified(second, sets, percent), "links2")
    so_far = components(links.unionByName(links2))
    spent.append(so_far)
    label2 = so_far.select(F.col("node").alias("u"), F.col("component").alias("v"))

    # last: whatever is still apart and can be linked by the bound on common shingles; only pairs judged on full sets are done with
    tested = first.unionByName(second).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = table(_within_bound(ranked, label2, percent, table).join(tested, ["u", "v"], "left_anti"), "pairs")
    more = _verified(pairs, sets, percent)
    found = cut(links.unionByName(links2).unionByName(more), "all_links")
    of_sets = cut(sig.select("set_id", "h1", "h2", "rep", "rep_th"), "of_sets")
    for t in spent:
        forget(t)
    return every, of_sets, found


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, less all but one of each group of near duplicates.

    A group is what similarity links, texts of one doc_id included; the one with the least doc_id stays. Different texts that repeat a doc_id
    and are no near duplicates all stay. Of rows equal in doc_id and text one stays, the first by the JSON of its other
    columns. Rows without words, null texts included, and rows without doc_id all stay. An empty table gives no rows.
    """
    with _settings(docs.sparkSession):
        rows, sets, links = _linked(_plain(docs, "doc_id", "text"), width, percent)
    whole = components(links)
    label = sets.join(whole, sets["set_id"] == whole["node"], "left").select("set_id", "rep", "rep_th", F.coalesce("component", "set_id").alias("component"))
    one = label.filter("component = set_id").select(F.col("rep").alias("_rep"), F.col("rep_th").alias("_th"))
    empty = rows.filter("n = 0 and doc_id is not null").select(F.col("doc_id").alias("_rep"), F.col("th").alias("_th")).distinct()
    keep = cut(one.unionByName(empty), "keep")
    twice = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id", "th").count().filter("count > 1").limit(1).count()
    for table in (rows, sets, links, whole):
        forget(table)
    names = docs.columns
    carry = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*carry)
    key, text = (F.col(carry[names.index(c)]) for c in ("doc_id", "text"))
    kept = plain.join(keep, (key.cast("bigint") == keep["_rep"]) & (F.xxhash64(text) == keep["_th"]), "left_semi")
    if twice:
        rest = [c for i, c in enumerate(carry) if i not in (names.index("doc_id"), names.index("text"))]
        worded = F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
        kept = kept.withColumn("_n", F.when(worded, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
        by = [carry[names.index("doc_id")], carry[names.index("text")], "_n"]
        other = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
        kept = kept.groupBy(*by).agg(F.min_by(other, F.to_json(other)).alias("_o"))
        kept = kept.select(*[F.col(c) if c in by else F.col("_o")[c].alias(c) for c in carry])
    return kept.unionByName(plain.filter(key.isNull())).toDF(*names)


def brute_force(rows: list[tuple[int, str | None]], width: int, percent: int) -> list[tuple[int, int]]:
    """For each row (set size, smallest doc_id reachable), by comparing all pairs; for tests."""
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [(len(x), find(d) if x else d) for d, x in sets]
