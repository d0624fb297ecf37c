"""Benchmark decontamination by Wu-Manber multi-pattern search over word windows.

A text is reduced to its lower-cased words, one space before each word and one at the end; a
window of an item becomes the byte string `` w1 ... wk ``. Windows are searched with shift tables over blocks of
bytes: the block that ends at the current position says how far the search may jump; a block that
ends some window selects, by that suffix, the few windows to compare directly.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import schema, slices, texts
from quern.state import cut, forget

WINDOW = 13
#: Windows are searched in blocks of at most so many bytes, each block broadcast on its own. The tables of a block take about nine times that in a task.
BLOCK_BYTES = 8 << 20

#: A-Z to a-z; bytes 00-2F, 3A-60, 7B-7F to a space; all others (digits, a-z, parts of longer characters) stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FOLD = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else _LOWER[b] for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered."""
    return text.translate(_FOLD).split()


def windows_of(text: bytes, width: int = WINDOW) -> list[bytes]:
    """The item's windows of ``width`` words, or its only window when it is shorter; none without words."""
    w = fold_words(text)
    if not w:
        return []
    k = min(width, len(w))
    return [b" " + b" ".join(w[i : i + k]) + b" " for i in range(len(w) - k + 1)]


class WuManber:
    """Shift tables for patterns of similar length; patterns of other lengths go to tables of their own."""

    def __init__(self, patterns: list[bytes]):
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in patterns:
            classes[min(len(p).bit_length(), 6)].append(p)
        self.tables = [self._table(ps) for _, ps in sorted(classes.items())]

    @staticmethod
    def _table(patterns: list[bytes]) -> tuple[int, int, dict[bytes, int], dict[bytes, list[bytes]]]:
        m = min(map(len, patterns))
        block = max(1, min(8, m // 2))
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(block, m + 1):
                b = p[end - block : end]
                if shift.get(b, m) > m - end:
                    shift[b] = m - end
            bucket[p[m - block : m]].append(p)
        return m, block, shift, dict(bucket)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence, overlapping ones too."""
        n = len(text)
        for m, block, shift, bucket in self.tables:
            jump, get, at = m - block + 1, shift.get, m
            while at <= n:
                step = get(text[at - block : at], jump)
                if step:
                    at += step
                    continue
                start = at - m
                for p in bucket[text[at - block : at]]:
                    if text.startswith(p, start):
                        yield start, p
                at += 1


def scan(text: bytes, searcher: WuManber, items: dict[bytes, list[str]]) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """Words of the text, merged byte ranges of hit words in the folded text, ids of items with occurring windows."""
    w = fold_words(text)
    if not w:
        return w, [], set()
    folded = b" " + b" ".join(w) + b" "
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    for start, p in searcher.find(folded):
        spans.append((start, start + len(p) - 1))
        found.update(items[p])
    merged: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            if e > merged[-1][1]:
                merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    ranges, at, n = [], 0, 0
    for s, e in merged:
        first = n + folded.count(b" ", at, s)
        n, at = first + folded.count(b" ", s, e), e
        ranges.append((first, n))
    return w, ranges, found


def item_windows(benchmark: DataFrame, width: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, window: every window of every item. Items of any size are cut in executors, so one of them may exceed a block."""

    def run(batches):
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                w = fold_words(text)
                k = min(width, len(w))
                for a in range(0, len(w) - k + 1 if w else 0, 10_000):
                    some = [b" " + b" ".join(w[i : i + k]) + b" " for i in range(a, min(a + 10_000, len(w) - k + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.binary())], ["item_id", "window"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    return items.mapInArrow(run, "item_id string, window binary")


def _blocks(windows: DataFrame) -> list[DataFrame]:
    """The windows in blocks of at most ``BLOCK_BYTES``, by a hash of the window: all owners of a window are in one block."""
    size = windows.agg(F.sum(F.length("window") + 32)).first()[0] or 0
    if size <= BLOCK_BYTES:
        return [windows]
    n = -(-2 * size // BLOCK_BYTES)  # room for uneven blocks
    return [windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k) for k in range(n)]


def _tables(rows: Iterable) -> tuple[WuManber, dict[bytes, list[str]]]:
    owners: dict[bytes, set[str]] = defaultdict(set)
    for r in rows:
        owners[bytes(r["window"])].update([] if r["item_id"] is None else [r["item_id"]])
    return WuManber(list(owners)), {p: sorted(v) for p, v in owners.items()}


_FOUND = "_words bigint, _hit array<array<bigint>>, _items array<string>"


def _searched(docs: DataFrame, tables: tuple, text: str, carry: list[str]) -> DataFrame:
    """``carry`` columns of ``docs`` plus ``_words``, ``_hit``, ``_items`` for one block: one row per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        searcher, items = shared.value
        for batch in slices(batches, text):
            n_words, hit, ids = [], [], []
            for t in texts(batch, text):
                w, spans, found = scan(t, searcher, items)
                n_words.append(len(w))
                hit.append([[a, b] for a, b in spans])
                ids.append(sorted(found))
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in carry), pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "_words", "_hit", "_items"])

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema(docs, carry, _FOUND))


def _search(docs: DataFrame, benchmark: DataFrame, width: int, item_col: str, item_text: str, text: str, carry: list[str]) -> DataFrame:
    """``carry`` columns of ``docs`` plus ``_words``, ``_hit``, ``_items``: one row per document row.

    One block is collected, searched and let go before the next: its hits go to a written table. Several blocks' hits are put together by a hash of the text,
    which is all a hit depends on; documents without any hit are in no such table.
    """
    windows = cut(item_windows(benchmark, width, item_col, item_text), "windows")
    blocks = _blocks(windows)
    if len(blocks) == 1:
        tables = _tables(blocks[0].toLocalIterator())
        forget(windows)
        return _searched(docs, tables, text, carry)
    parts = []
    for block in blocks:
        tables = _tables(block.toLocalIterator())
        one = docs.select(F.col(text).alias("_text")).filter("_text is not null")
        hits = _searched(one.withColumn("_h", _text_name(F.col("_text"))), tables, "_text", ["_h"])
        parts.append(cut(hits.filter(F.size("_hit") > 0).select("_h", "_hit", "_items").dropDuplicates(["_h"]), "hits"))
    forget(windows)
    both = reduce(DataFrame.unionByName, parts)
    both = both.groupBy("_h").agg(F.array_sort(F.flatten(F.collect_list("_hit"))).alias("_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))  # a row for each block at most
    counted = _searched(docs.withColumn("_h", _text_name(F.col(text))), (WuManber([]), {}), text, [*carry, "_h"]).drop("_hit", "_items")
    found = counted.join(both, "_h", "left")
    none = {"_hit": "array<array<bigint>>", "_items": "array<string>"}
    return found.select(*carry, "_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])


def _text_name(text: Column) -> Column:
    """What equal texts, and no others, have in common."""
    return F.sha2(text, 256)


def _n_hit():
    """Words under the sorted ranges in ``_hit``; ranges of several blocks may overlap and count once."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        "_hit",
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(zero, x[1] - F.greatest(x[0], a["end"]))).alias("n"), F.greatest(a["end"], x[1]).alias("end")),
        lambda a: a["n"],
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where windows of benchmark items occur in documents.

    One row per document row: ``doc_id, n_words``, ``hit`` (ranges of word numbers, end exclusive) and
    ``items`` (sorted ids of items with occurring windows). A null text has no words, a null
    item text no windows, an item without id has windows (they count as hits) but is not in ``items``, items without words match nothing, repeated rows are handled one by one;
    other columns are ignored. A benchmark whose windows exceed ``BLOCK_BYTES`` is searched block by block, one of them on the driver at a time, and the
    blocks' hits are united per document; items of any size are cut into windows first.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _search(docs, benchmark, width, item_col, item_text, "text", ["doc_id"])
    return found.select("doc_id", F.col("_words").alias("n_words"), F.col("_hit").alias("hit"), F.col("_items").alias("items"), _n_hit().alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20, **cols: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    return occurrences(docs, benchmark, width, **cols).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20, text_col: str = "text") -> DataFrame:
    """The documents (all their columns, whatever their names) that are not contaminated; null texts stay."""
    names = docs.columns
    carry = [f"c{i}" for i in range(len(names))]
    found = _search(docs.toDF(*carry), benchmark, width, "item_id", "text", carry[names.index(text_col)], carry).withColumn("_n", _n_hit())
    return found.filter(~((F.col("_n") > 0) & (F.col("_n") * share >= F.col("_words")))).select(*carry).toDF(*names)


def brute_force(rows: list[tuple[int, str | None]], items: list[tuple[str, str | None]], width: int = WINDOW) -> dict[int, tuple]:
    """The same judgement by comparing every word window with every window, for tests."""
    import re

    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = []
    for i, t in items:
        w = low(t)
        k = min(width, len(w))
        wins += [(i, w[a : a + k]) for a in range(len(w) - k + 1)] if w else []
    out = {}
    for d, t in rows:
        w, hit, ids = low(t), set(), set()
        for i, p in wins:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    ids.add(i)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out
