"""Document fingerprints by locally consistent parsing.

A text is a sequence of bytes. On each level runs of one symbol become one symbol; deterministic coin
tossing (the lowest bit in which a symbol differs from its left neighbour, three times over) gives labels below a small
constant in which neighbours differ; a symbol whose label is a local maximum begins a phrase; a phrase is named by the hash of its
symbols and is a symbol of the next level, until one phrase is left. What a phrase is depends on a few symbols around it, not on its
offset: equal substrings have equal interior phrases on every level. A fingerprint keeps the least names of each level; the
share of common ones estimates how much of two texts is the same.

Short texts are parsed many at a time, end to end. Long texts are parsed in chunks that flow through all levels at once: each
level holds back only the symbols whose phrase is not decided yet, so the memory needed does not grow with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import joined, mix, schema, slices, texts

#: Names kept of the first level, of the second, and of each one above; phrases of level k have about 3**k bytes.
KEPT = (8, 16, 32)
#: The first level whose phrases (some 27 bytes, four or five words) two unlike texts hardly share.
TELLING = 3
#: A lower level speaks for two texts when each has at least so many names on it.
ENOUGH = 6
#: Texts are parsed in groups of so many bytes; a longer text in chunks of that size.
CHUNK = 1 << 18

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_POW = np.full(4096, 0xD6E8FEB86659FD93, np.uint64)
_POW[0] = 1
np.multiply.accumulate(_POW, out=_POW)


def _coin(n: int) -> np.ndarray:
    """coin[a, b]: place and value of the lowest bit in which a differs from its left neighbour b."""
    a, b = np.arange(n)[:, None], np.arange(n)[None, :]
    x = a ^ b
    place = np.where(x, np.log2(np.maximum(x & -x, 1)).astype(int), 0)
    return (2 * place + (a >> place & 1)).astype(np.uint8)


_COIN = _coin(256)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))

def _shift(x: np.ndarray, starts: np.ndarray, edge: int) -> np.ndarray:
    """Left neighbours; ``edge`` at the first symbol of each row."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = edge
    return out


def _exponent(bit: np.ndarray) -> np.ndarray:
    """Places of the only set bits: the exponents of the same values as floating point numbers; 0 for none."""
    e = bit.astype(np.float64).view(np.int64)
    e >>= 52
    e -= 1023
    np.maximum(e, 0, out=e)
    return e.astype(np.uint8)


def _labels(names: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Coins tossed three times: labels below a small constant that differ between neighbours."""
    left = _shift(names, heads, 0)
    np.bitwise_xor(left, names, out=left)
    left &= ~left + _U(1)  # the lowest bit that differs
    label = _exponent(left)
    label <<= 1
    left &= names
    label += left != 0
    for _ in range(2):
        label = _COIN[label, _shift(label, heads, 255)]
    return label


def _begins(label: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where phrases begin: at the heads of rows and at local maxima, but not right after a head."""
    right = np.empty_like(label)
    right[:-1] = label[1:]
    right[ends - 1] = 0
    begin = (label > _shift(label, heads, 0)) & (label > right)
    begin[heads] = True
    second = heads + 1
    begin[second[second < ends]] = False  # a phrase has two symbols at least, so that levels end
    return begin


def _names(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the phrases that begin at ``at`` and follow each other to the end."""
    lead = int(at[0])
    length = np.diff(np.append(at, len(names)))
    within = np.arange(lead, len(names)) - np.repeat(at, length)
    np.minimum(within, len(_POW) - 1, out=within)
    return mix(np.add.reduceat(names[lead:] * _POW[within], at - lead) + length.astype(np.uint64))


def next_level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of all rows end to end, and the n + 1 offsets; every row has at least one symbol."""
    n = len(names)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(names[1:], names[:-1], out=first[1:])
    first[starts[:-1]] = True
    at = np.flatnonzero(first)
    if len(at) < n:
        runs = np.diff(np.append(at, n)).astype(np.uint64)
        names = names[at]
        long = np.flatnonzero(runs > 1)
        names[long] = mix(names[long] + runs[long] * _ODD)
        starts = np.searchsorted(at, starts)
    at = np.flatnonzero(_begins(_labels(names, starts[:-1]), starts[:-1], starts[1:]))
    return _names(names, at), np.searchsorted(at, starts)


def _kept(level: int) -> int:
    return KEPT[min(level, len(KEPT)) - 1]


def _short(names: np.ndarray) -> np.ndarray:
    """32 bits of each name, in an order that has nothing to do with the order of the names."""
    return (names >> _U(32)).astype(np.uint32) * np.uint32(0x9E3779B1)


def _hex(least: np.ndarray) -> str:
    return least.astype(">u4").tobytes().hex()


class _Level:
    """One level of one long text, chunk by chunk: the same phrases as ``next_level`` makes of the whole."""

    def __init__(self):
        self.run: tuple[int, int] | None = None  # the last run, which may go on: its symbol and length
        self.held = np.zeros(0, np.uint64)  # symbols from some before the open phrase on
        self.open = 0  # where in them the open phrase begins
        self.fresh = True  # the first of them is the first of the text

    def _runs(self, names: np.ndarray, last: bool) -> np.ndarray:
        """Runs as symbols; the last run waits for the next chunk."""
        if not len(names):
            values, lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        else:
            at = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            values, lengths = names[at], np.diff(np.append(at, len(names)))
        if self.run is not None:
            if len(values) and int(values[0]) == self.run[0]:
                lengths[0] += self.run[1]
            else:
                values, lengths = np.append(_U(self.run[0]), values), np.append(self.run[1], lengths)
        self.run = None
        if not last and len(values):
            self.run = int(values[-1]), int(lengths[-1])
            values, lengths = values[:-1], lengths[:-1]
        return np.where(lengths > 1, mix(values + lengths.astype(np.uint64) * _ODD), values)

    def push(self, names: np.ndarray, last: bool) -> np.ndarray:
        """Names of the phrases that are complete once these symbols are known; all that are left with ``last``."""
        x = np.concatenate((self.held, self._runs(names, last)))
        if not len(x):
            return x
        label = _labels(x, np.zeros(1, np.int64))
        begin = _begins(label, np.zeros(1, np.int64), np.array([len(x)]))
        if not last:
            begin[-1] = False  # its right neighbour is not known
        # what stands before the open phrase is there for the labels of what follows only
        at = np.append(self.open, np.flatnonzero(begin[self.open + 1 :]) + self.open + 1)
        done = _names(x[: len(x) if last else at[-1]], at if last else at[:-1]) if last or len(at) > 1 else np.zeros(0, np.uint64)
        # four symbols to the left decide a label and whether it is a maximum
        keep = 0 if self.fresh and at[-1] <= 4 else max(int(at[-1]) - 4, 0)
        self.fresh = self.fresh and keep == 0
        self.held, self.open = x[keep:].copy(), int(at[-1]) - keep
        return done


def _long(text: bytes) -> str:
    """The fingerprint of one long text, from chunks of it."""
    levels: list[_Level] = []
    least: list[np.ndarray] = []
    made: list[int] = []

    def push(k: int, names: np.ndarray, last: bool) -> None:
        if k == len(levels):
            if not len(names) or (last and len(names) == 1 and k and made[k - 1] == 1):
                return
            levels.append(_Level())
            least.append(np.zeros(0, np.uint32))
            made.append(0)
        out = levels[k].push(names, last)
        made[k] += len(out)
        least[k] = np.unique(np.concatenate((least[k], _short(out))))[: _kept(k + 1)]
        if k + 1 < len(levels) or made[k] > 1 or last:
            waiting[k].append(out)
            whole = waiting[k][0] if len(waiting[k]) == 1 else np.concatenate(waiting[k])
            waiting[k] = []
            push(k + 1, whole, last)
        else:
            waiting[k].append(out)

    waiting: list[list[np.ndarray]] = [[] for _ in range(64)]
    for a in range(0, len(text), CHUNK):
        push(0, _BYTES[np.frombuffer(text, np.uint8, min(CHUNK, len(text) - a), a)], a + CHUNK >= len(text))
    return ".".join(map(_hex, least))


def _group(rows: list[bytes]) -> list[str]:
    """Fingerprints of non-empty texts, parsed together."""
    data, starts = joined(rows)
    names, alive = _BYTES[data], np.arange(len(rows))
    out: list[list[str]] = [[] for _ in rows]
    level = 0
    while len(alive):
        level += 1
        names, starts = next_level(names, starts)
        # the least distinct names of each row: rows and names in one sorted array
        count = np.diff(starts)
        pair = np.repeat(np.arange(len(alive), dtype=np.uint64), count) << _U(32) | _short(names)
        pair.sort()
        pair = pair[np.append(True, pair[1:] != pair[:-1])]
        ends = np.searchsorted(pair >> _U(32), np.arange(len(alive) + 1, dtype=np.uint64))
        digits = _hex(pair.astype(np.uint32))
        for i, a, b in zip(alive.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i].append(digits[8 * a : 8 * min(b, a + _kept(level))])
        more = count > 1
        if not more.all():
            names = names[np.repeat(more, count)]
            starts = np.append(0, np.cumsum(count[more]))
            alive = alive[more]
    return [".".join(x) for x in out]


def fingerprints(rows: list[bytes]) -> list[str]:
    """A hexadecimal string for each text: its least phrase names by level, levels parted by ``.``; empty for an empty text.

    The last level has the one phrase that is the whole text.
    """
    out = ["" for _ in rows]
    some: list[int] = []
    size = 0
    for i, t in enumerate(rows):
        if len(t) > CHUNK:
            out[i] = _long(t)
        elif t:
            some.append(i)
            size += len(t)
        if some and (size >= CHUNK or i + 1 == len(rows)):
            for k, f in zip(some, _group([rows[k] for k in some]), strict=True):
                out[k] = f
            some, size = [], 0
    if some:
        for k, f in zip(some, _group([rows[k] for k in some]), strict=True):
            out[k] = f
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1: the greatest share of common names over the levels from TELLING on; 1 for equal fingerprints.

    A level that only one of the two has says nothing. Where one of them has few names on level TELLING, the highest level below on which both have
    enough speaks as well, or the first if there is none.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    levels = [tuple([x[i : i + 8] for i in range(0, len(x), 8)] for x in pair) for pair in zip(a.split("."), b.split("."), strict=False)]
    at = [k for k in range(len(levels)) if k + 1 >= TELLING]
    if not at or min(map(len, levels[TELLING - 1])) < ENOUGH:
        below = [k for k, (x, y) in enumerate(levels[: TELLING - 1]) if min(len(x), len(y)) >= ENOUGH]
        at.append(max(below, default=0))
    best = 0.0
    for k in at:
        x, y = map(set, levels[k])
        if x & y:
            union = sorted(x | y)[: _kept(k + 1)]
            best = max(best, sum(i in x and i in y for i in union) / len(union))
    return best


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_chars (code points), fingerprint. Null texts count as empty; equal texts have equal fingerprints."""

    def run(batches):
        for batch in slices(batches):
            rows = texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.decode()) for t in rows], pa.int64()), pa.array(fingerprints(rows))], ["doc_id", "n_chars", "fingerprint"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, schema(docs, ["doc_id"], "n_chars bigint, fingerprint string"))


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents dealt out by ranges of doc_id and sorted falling, each range followed by the row that comes next.

    Columns: bucket, guest (whether the row only follows), doc_id, text. The bounds of the ``parts`` ranges (four for each shuffle
    partition) are quantiles of the ids, so one id far away does not empty the others; they and the largest id of each range are all the driver
    sees. The range after the last is the first again. Rows without doc_id come last; rows that repeat a doc_id are ordered by
    text and lie in one range.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * parts))).first()[0]
    bounds = sorted(set(found or []))
    # how many bounds are not above the id, by halving: bounds are filled up to a power of two
    size = 1 << len(bounds).bit_length()
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds + [None] * (size - len(bounds))]) if size <= 64 else F.lit([*bounds, *[(1 << 63) - 1] * (size - len(bounds))]).cast("array<bigint>")
    steps = F.lit([1 << k for k in range(size.bit_length() - 2, -1, -1)] or [0])
    below = F.aggregate(steps, F.lit(0), lambda n, s: F.when((s > 0) & (n + s <= len(bounds)) & (F.try_element_at(table, n + s) <= F.col("doc_id")), n + s).otherwise(n))
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below + 1))
    tops = {r["range"]: r["top"] for r in docs.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    filled = sorted(tops)
    # the row that follows a range is the largest of the one below; the largest of all follows the lowest
    follows = {tops[filled[k]]: filled[(k + 1) % len(filled)] for k in range(len(filled))}
    named = spark.createDataFrame([(i, to) for i, to in follows.items() if i is not None], "doc_id bigint, to int")  # a row for each range
    docs = docs.join(F.broadcast(named), "doc_id", "left")
    if None in follows:
        docs = docs.withColumn("to", F.when(F.col("doc_id").isNull(), F.lit(follows[None])).otherwise(F.col("to")))
    own = F.struct(F.col("range").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    out = docs.select(F.inline(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))), "doc_id", "text")
    return out.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next text.

    Per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document has the next lower doc_id; after the lowest comes the highest. Null texts count as empty, rows without doc_id
    come last (in the order of their texts), rows that repeat a doc_id follow each other by text; a single row is its own next.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, bytes]]:
        """(doc_id, text, next text): rows wait for the one after them; guests only follow."""
        last = None
        for batch in batches:
            for b, g, d, t in zip(*(batch.column(i).to_pylist() for i in range(3)), texts(batch), strict=True):
                if last is not None and last[0] == b:
                    yield last[1], last[2], t
                last = None if g else (b, d, t)

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        rows: list[tuple] = []

        def flush():
            own, following = [t for _, t, _ in rows], [x for _, _, x in rows]
            plain = [t.decode() for t in own]
            new = [edited(t, x.decode()).encode() for t, x in zip(plain, following, strict=True)]
            # the next text is as a rule the next row: equal texts are parsed once
            distinct = list(dict.fromkeys([*own, *following, *new]))
            of = dict(zip(distinct, fingerprints(distinct), strict=True))
            f, e, x = ([of[t] for t in ts] for ts in (own, new, following))
            made = [
                [d for d, _, _ in rows], [len(t) for t in plain], [hashlib.sha256(t).hexdigest() for t in new], f, e,
                [likeness(a, b) for a, b in zip(f, e, strict=True)], [likeness(a, b) for a, b in zip(f, x, strict=True)],
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names)

        size = 0
        for row in pairs(batches):
            rows.append(row)
            # the own text, the next one, and the edited one, which has at most half of the code points of the next
            size += 64 + 2 * (len(row[1]) + len(row[2]))
            if size >= 2 * CHUNK:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return in_order(docs).mapInArrow(run, schema(docs, ["doc_id"], "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
