"""Packing documents into training windows by best-fit decreasing.

Overlong documents are first cut into full windows; the tails are packed. Pieces of
one length are interchangeable, so best-fit decreasing needs only how many pieces of each length there
are: at most ``window`` numbers, whatever the size of the corpus. The driver packs those counts, whole runs of
equal windows at a time, with a segment tree over remaining capacity that finds the tightest open window. The
plan maps (length, rank among pieces of that length) to a window and offset; its size depends on the window
only. Executors rank the pieces inside salted buckets and look their places up.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from array import array
from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._bytes import schema, slices, texts
from quern.llm._segments import Remembered
from quern.state import cut

WINDOW = 2048
END_ID = 1

#: Code points whose classes this file knows; texts with others go to the library whole.
_KNOWN = 0x250
_SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by Unicode's general category."""
    out = np.zeros(_KNOWN, np.uint8)
    for c in range(_KNOWN):
        kind = unicodedata.category(chr(c))
        out[c] = 3 if c in _SPACES else 1 if kind[0] == "L" else 2 if kind[0] == "N" else 0
    return out


_CLASS = _classes()
_LOW = bytes(range(0xC9))


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer, a merger of single words or None, and the special strings.

    The merger works by ranks instead of a list of merges: the same thing, if every merge makes the token
    next in order, which is looked at here. Otherwise, and for any other kind of tokenizer, whole texts go to the library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    about = json.loads(library.to_str())
    pre, model, post = about.get("pre_tokenizer") or {}, about["model"], about.get("post_processor") or {}
    plain = about.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and post.get("type", "ByteLevel") == "ByteLevel"
    special = [t["content"] for t in about.get("added_tokens", [])]
    merger = None
    if plain:
        vocab = model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        letters = _byte_letters()
        if all(a < b for a, b in zip(made, made[1:], strict=False)) and all(x in vocab for x in letters):
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
            singles = sum(len(t) == 1 for t in ranks)
            if singles == 256 and len(ranks) == 256 + len(made) and max(ranks[bytes([b])] for b in range(256)) < made[0]:
                merger = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return library, merger, special


def word_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern begins a new word, for rows of known code points laid end to end.

    The pattern: contractions, then optional space plus letters, numbers or others, then white space
    that leaves its last character to what follows.
    """
    n = len(codes)
    kind = _CLASS[codes]
    head = np.zeros(n + 1, bool)
    head[starts] = True
    space = kind == 3
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= head[:n]
    begin = change.copy()
    follows = np.zeros(n, bool)  # a non-space of the same row follows
    follows[:-1] = ~space[1:] & ~head[1:n]
    last = space & follows  # the last of a run of white space before something
    begin |= last
    after = np.zeros(n, bool)
    after[1:] = last[:-1] & (codes[:-1] == 32)
    begin &= ~after  # what follows a plain space takes it along
    # contractions: an apostrophe that begins a word of others, right before the letters
    quote = np.flatnonzero((codes == 39) & begin)
    if len(quote):
        # any quote that starts a word and is followed by a letter of the same row
        ends = starts[np.searchsorted(starts, quote, side="right")]
        for q, end in zip(quote.tolist(), ends.tolist(), strict=True):
            tail = "".join(map(chr, codes[q + 1 : min(q + 3, end)].tolist()))
            hit = next((x for x in _CONTRACTIONS if tail.startswith(x)), None)
            if hit:
                begin[q + 1] = False
                rest = q + 1 + len(hit)
                if rest < end:
                    # letters go on as a new word; anything else begins one by itself or is a white space run
                    if kind[rest] == 1:
                        begin[rest] = True
    return begin


class Encoder:
    """Token ids of whole texts as the library gives them, plus a closing id."""

    def __init__(self, path: str, end_id: int | None = END_ID):
        self.library, self.merger, self.special = _library(path)
        self.end = [] if end_id is None else [end_id]
        self.words = Remembered(self._words, 0)  # merging a word costs no more than remembering it

    def _words(self, parts: list[bytes]) -> list[bytes]:
        one = self.merger._core_bpe.encode_single_piece
        known = self.merger._mergeable_ranks.get
        return [array("I", one(p) if (k := known(p)) is None else (k,)).tobytes() for p in parts]

    def __call__(self, rows: list[bytes]) -> list[np.ndarray]:
        out: list = [b""] * len(rows)
        fast, slow, texts_ = [], [], []
        for i, t in enumerate(rows):
            s = t.decode()
            # bytes from C9 on begin code points of at least 240 hex: a cheap look first
            if self.merger and (s.isascii() or not t.translate(None, _LOW) or ord(max(s)) < _KNOWN) and not any(x in s for x in self.special):
                if s:
                    fast.append(i)
                    texts_.append(s)
            else:
                slow.append((i, s))
        for i, s in slow:
            out[i] = np.array(self.library.encode(s, add_special_tokens=False).ids, np.uint32).tobytes()
        if fast:
            codes = np.frombuffer("".join(texts_).encode("utf-16-le"), np.uint16)
            starts = np.zeros(len(fast) + 1, np.int64)
            np.cumsum([len(s) for s in texts_], out=starts[1:])
            at = np.flatnonzero(word_starts(codes, starts))
            width = 1 + (codes > 127)  # bytes of each code point below 0x800
            where = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(width, out=where[1:])
            begin = where[at]
            data = np.frombuffer(b"".join(rows[i] for i in fast), np.uint8)
            values, place = self.words(data, begin, np.append(begin[1:], len(data)))
            ids = [values[p] for p in place.tolist()]
            first = np.append(np.searchsorted(at, starts[:-1]), len(at)).tolist()
            for k, i in enumerate(fast):
                out[i] = b"".join(ids[first[k] : first[k + 1]])
        return [np.append(np.frombuffer(x, np.uint32), np.array(self.end, np.uint32)) for x in out]


class Tightest:
    """A segment tree over capacities 0..n: the smallest capacity of at least x that is marked."""

    def __init__(self, n: int):
        self.base = 1 << (n + 1).bit_length()
        self.any = bytearray(2 * self.base)

    def mark(self, i: int, on: bool) -> None:
        i += self.base
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def at_least(self, x: int) -> int | None:
        i = x + self.base
        if self.any[i]:
            return x
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan for ``counts`` pieces of each length, and the number of windows.

    Rows (length, from_rank, to_rank, first_window, per_window, first_offset): piece ``r`` of that length goes to window
    ``first_window + (r - from_rank) // per_window`` at ``first_offset + (r - from_rank) % per_window * length``.
    Equal to placing the pieces one by one, longest first, each in the open window with the least room that fits.
    """
    tree = Tightest(window)
    open_: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    plan, total = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_[room]:
                tree.mark(room, True)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                each = window // length
                n = -(-left // each)
                first, room = total, window
                total += n
            else:
                first, n = open_[room].popleft()
                if not open_[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, window - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and left and left < each:
                plan.append((length, rank, rank + left, first + full, left, window - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return plan, total


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut into full windows and a tail: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        encode = Encoder(tokenizer, end_id)
        for batch in slices(batches):
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encode(texts(batch))):
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    row.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    if sys.byteorder != "little":
        raise RuntimeError("ids_crc32 is of little-endian ids")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, schema(docs, ["doc_id"], "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int | None = END_ID, **cols: str) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the closing id alone; repeated rows are packed each for itself (their pieces are equal,
    and so are told apart by rank only); an empty table gives no rows. Windows are numbered from 0, packed tails first, then
    full windows. Within a window pieces lie gapless from offset 0.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer, window, end_id, **cols), "pieces")
    # buckets keep the pieces of one length apart: about 20,000 rows of all lengths in each
    n = max(64, made.count() // 20_000)
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)))
    counts = cut(made.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    plan, total = best_fit_decreasing({k: v for k, v in sizes.items() if k < window}, window)
    if window in sizes:
        plan.append((window, 0, sizes[window], total, 1, 0))
    # at most a few rows for each length: bounded by the window, not by the corpus
    steps: dict[int, list[tuple]] = defaultdict(list)
    for length, a, b, first, each, offset in plan:
        steps[length].append((a, b, first, each, offset))
    lookup = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in steps.items()})
    ranked = (
        made.join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    )

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                step = lookup.value[int(k)]
                r = rank[rows]
                s = step[np.searchsorted(step[:, 0], r, side="right") - 1]
                d = r - s[:, 0]
                seq[rows] = s[:, 2] + d // s[:, 3]
                off[rows] = s[:, 4] + d % s[:, 3] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in out[:5]), pa.array(seq), pa.array(off)], out)

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return ranked.select(*out[:5], "rank").mapInArrow(place, schema(made, out[:5], "sequence_id bigint, offset bigint"))
