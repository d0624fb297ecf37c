"""Encoding and decoding with merge-type sentencepiece vocabularies.

A text is a row of symbols, at first its characters. An agenda holds every adjacent pair whose two symbols spell a piece, ordered by the piece's
score and then by place; the best pair is merged, the pairs of its two neighbours enter the agenda, until it is empty. No piece holds a line
break, nor a space after another character, so texts are cut there: each distinct segment of a batch is encoded once, all of them abreast in
numpy (one merge a segment and round), long ones by a heap. What is encoded is compared with the sentencepiece library batch by batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import RangeHash, joined, schema, slices, texts

MARK = "▁"
#: Segments up to this many characters are merged abreast, so many at a time; distinct segments remembered by a task (of 64 bytes at most).
ABREAST, ROWS, REMEMBER = 48, 16_384, 200_000
#: Bytes of a text that are worked on at once, where it has a place to be cut.
PART_BYTES = 1 << 18
#: Parts that are encoded together, ids of a text that are checked at once, and rows that are decoded together.
TOGETHER, CHECKED_IDS, DECODE_ROWS = 1 << 20, 1 << 16, 256
_NONE = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value: object = number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Vocabulary:
    """A model's pieces, and for pairs of symbols the piece that they spell.

    Symbols are piece ids; characters that only occur inside of pieces have numbers from ``len(pieces)`` on.
    """

    pieces: list[bytes]
    kinds: np.ndarray
    rank: np.ndarray  # by falling score, equal scores equal
    byte_ids: np.ndarray
    end: int
    points: np.ndarray  # code points of known characters, rising, and their symbols
    symbols: np.ndarray
    keys: np.ndarray  # left symbol * width + right symbol, rising, and the pieces of these pairs
    made: np.ndarray
    width: int

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols spell, -1 for none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def characters(self, points: np.ndarray) -> np.ndarray:
        """The symbols of code points; unknown ones are -2 - code point."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.symbols[at], -2 - points.astype(np.int64)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file; models whose texts are changed before encoding, or that do not merge, are refused."""
    with open(path, "rb") as f:  # a model file that every executor has, as the library itself opens it
        data = f.read()
    names, scores, kinds, trainer, normal = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            names.append(x[1].decode())
            scores.append(np.frombuffer(x.get(2, b"\0" * 4), "<f4")[0])
            kinds.append(x.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    kinds = np.array(kinds)
    if trainer.get(3) != BPE or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or set(kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE} or (kinds == BYTE).sum() != 256:
        raise ValueError(f"not a merge-type vocabulary with bytes for unknown characters and texts left as they are: {path}")
    spelled = {n: i for i, n in enumerate(names) if kinds[i] == NORMAL}
    if any("\n" in n or MARK in n.lstrip(MARK) for n in spelled):
        raise ValueError(f"pieces reach over line breaks or spaces: {path}")
    single = sorted({c for n in spelled for c in n})
    symbol = dict(spelled)
    for c in single:
        symbol.setdefault(c, len(names) + len(symbol) - len(spelled))
    width = len(names) + len(symbol) - len(spelled)
    pairs = {symbol[n[:i]] * width + symbol[n[i:]]: k for n, k in spelled.items() for i in range(1, len(n)) if n[:i] in symbol and n[i:] in symbol}
    keys = np.array(sorted(pairs), np.int64)
    _, falling = np.unique(-np.array(scores, np.float64), return_inverse=True)
    byte_ids = np.zeros(256, np.int32)
    plain = []
    for i, n in enumerate(names):
        if kinds[i] == BYTE:
            byte_ids[int(n[3:-1], 16)] = i
            plain.append(bytes([int(n[3:-1], 16)]))
        else:
            plain.append(b"" if kinds[i] == CONTROL else n.replace(MARK, " ").encode())
    if UNKNOWN in kinds:
        plain[int(np.flatnonzero(kinds == UNKNOWN)[0])] = trainer[44] if 44 in trainer else " ⁇ ".encode()
    points = np.array([ord(c) for c in single] + [32], np.int64)
    symbols = np.array([symbol[c] for c in single] + [symbol[MARK]], np.int64)
    order = np.argsort(points)
    return Vocabulary(plain, kinds, falling.reshape(-1).astype(np.int32), byte_ids, int(trainer.get(42, 2)), points[order], symbols[order], keys, np.array([pairs[k] for k in keys.tolist()], np.int64), width)


def agenda(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The symbols left when no adjacent pair of one row spells a piece: a heap of (rank, place)."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    found = v.merged(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)).tolist() if n > 1 else []
    heap = [(int(v.rank[p]), i, symbols[i], symbols[i + 1], p) for i, p in enumerate(found) if p >= 0]
    heapq.heapify(heap)
    table = dict(zip(v.keys.tolist(), v.made.tolist(), strict=True)) if heap and n > 4 * ABREAST else None
    pair = (lambda a, b: table.get(a * v.width + b, -1) if a >= 0 and b >= 0 else -1) if table else lambda a, b: int(v.merged(np.array([a]), np.array([b]))[0])
    while heap:
        _, i, left, right, piece = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = piece, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := pair(piece, symbols[k])) >= 0:
                heapq.heappush(heap, (int(v.rank[p]), i, piece, symbols[k], p))
        if (h := before[i]) >= 0 and (p := pair(symbols[h], piece)) >= 0:
            heapq.heappush(heap, (int(v.rank[p]), h, symbols[h], piece, p))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def abreast(v: Vocabulary, rows: np.ndarray) -> np.ndarray:
    """``agenda`` for many rows at once, padded by -1; merged symbols leave -1 behind. One merge a row and round."""
    m, n = rows.shape
    out = np.full((m, n), -1, np.int64)
    live, s = np.arange(m), rows.copy()
    after, before = np.tile(np.arange(1, n + 1), (m, 1)), np.tile(np.arange(-1, n - 1), (m, 1))
    piece = np.full((m, n), -1, np.int64)
    piece[:, :-1] = v.merged(s[:, :-1], s[:, 1:])
    rank = np.where(piece >= 0, v.rank[piece], _NONE)
    while len(live):
        at = rank.argmin(1)  # of equal ranks the first place
        row = np.arange(len(live))
        go = rank[row, at] < _NONE
        if not go.all():
            out[live[~go]] = s[~go]
            live, s, after, before, piece, rank, at = live[go], s[go], after[go], before[go], piece[go], rank[go], at[go]
            row = np.arange(len(live))
            if not len(live):
                break
        gone = after[row, at]
        new = piece[row, at]
        s[row, at], s[row, gone] = new, -1
        rank[row, gone] = _NONE
        k, h = after[row, gone], before[row, at]
        after[row, at] = k
        inside = k < n
        before[row[inside], k[inside]] = at[inside]
        right = np.where(inside, s[row, np.minimum(k, n - 1)], -1)
        p = v.merged(new, right)
        piece[row, at], rank[row, at] = p, np.where(p >= 0, v.rank[p], _NONE)
        w = h >= 0
        r, hw = row[w], h[w]
        p = v.merged(s[r, hw], new[w])
        piece[r, hw], rank[r, hw] = p, np.where(p >= 0, v.rank[p], _NONE)
    return out


@dataclass
class Ragged:
    """Rows of numbers end to end."""

    pool: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def __getitem__(self, i: int) -> np.ndarray:
        at = int(self.sizes[:i].sum())
        return self.pool[at : at + int(self.sizes[i])]

    def take(self, rows: np.ndarray) -> Ragged:
        """Chosen rows, in the order given."""
        each = self.sizes[rows]
        return Ragged(self.pool[np.repeat(self.starts[rows] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))], each)


class Codec:
    """Ids of texts and texts of ids, with what the library gives as the measure: where the two differ, the library's counts."""

    def __init__(self, path: str, remember: int = REMEMBER):
        import sentencepiece

        self.v, self.library = vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
        # segments by name, with an entry of no segment so that there always is one
        self.remember, self.names, self.known, self.wrong = remember, np.zeros(1, np.uint64), Ragged(np.zeros(0, np.int32), np.zeros(1, np.int64)), np.zeros(1, np.int64)
        self.pieces = pa.array(self.v.pieces, pa.binary())
        self.plain = next(i for i, x in enumerate(self.v.pieces) if self.v.kinds[i] == NORMAL and x.isalpha() and x.isascii())
        self.ahead = self.library.encode("\n")  # a line break before a segment keeps the library from putting a space there

    def _expanded(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, unknown characters as bytes; and how many ids each symbol has."""
        known = (symbols >= 0) & (symbols < len(self.v.pieces))
        if known.all():
            return symbols.astype(np.int32), np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(~known)
        inner = dict(zip(self.v.symbols.tolist(), self.v.points.tolist(), strict=True))
        raw = [chr(-2 - x if x < 0 else inner[x]).encode() for x in symbols[odd].tolist()]
        size = np.ones(len(symbols), np.int64)
        size[odd] = [len(r) for r in raw]
        out = np.repeat(symbols, size)
        start = np.cumsum(size) - size
        for at, r in zip(start[odd].tolist(), raw, strict=True):
            out[at : at + len(r)] = self.v.byte_ids[np.frombuffer(r, np.uint8)]
        return out.astype(np.int32), size

    def merge(self, parts: list[bytes]) -> Ragged:
        """Ids of segments (not empty) by the agenda alone."""
        points = np.frombuffer(b"".join(parts).decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter((len(p.decode()) for p in parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        symbols = self.v.characters(points)
        many = np.flatnonzero(sizes > ABREAST)
        long = [self._expanded(np.array(agenda(self.v, symbols[starts[i] : starts[i] + sizes[i]].tolist()), np.int64))[0] for i in many.tolist()]
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= ABREAST]
        pools, counts = [*long], [len(x) for x in long]
        for begin in range(0, len(order), ROWS):
            block = order[begin : begin + ROWS]
            n = int(sizes[block].max())
            place = starts[block][:, None] + np.arange(n)
            rows = np.where(np.arange(n) < sizes[block][:, None], symbols[np.minimum(place, len(symbols) - 1)], -1)
            done = abreast(self.v, rows)
            kept = done != -1
            ids, size = self._expanded(done[kept])
            pools.append(ids)
            counts += np.add.reduceat(size, np.cumsum(kept.sum(1)) - kept.sum(1)).tolist()
        made = Ragged(np.concatenate(pools), np.array(counts, np.int64))
        return made.take(np.argsort(np.concatenate([many, order]), kind="stable"))

    def checked(self, parts: list[bytes]) -> tuple[Ragged, np.ndarray]:
        """Ids of segments, and which the library gives otherwise: its ids where they differ from the agenda's."""
        mine, skip = self.merge(parts), len(self.ahead)
        theirs = self.library.encode(["\n" + p.decode() for p in parts], num_threads=1)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum()))
        places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        right = Ragged(flat[places >= skip], sizes - skip)
        wrong = mine.sizes != right.sizes
        if not wrong.any():
            wrong = np.add.reduceat(mine.pool != right.pool, mine.starts) > 0
        else:
            wrong = np.array([not np.array_equal(mine[i], right[i]) for i in range(len(parts))])
        return right, wrong.astype(np.int64)

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts of texts end to end, the number of ids of each part, and of segments that the library corrected.

        A part is whole in itself: it begins where a text begins (a space before it stands for the library's own), or where texts may be cut.
        """
        data, starts = joined([p.replace(MARK.encode(), b" ") for p in parts])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        begin = _boundaries(data)
        begin[starts[:-1][starts[:-1] < len(data)]] = True
        at = np.flatnonzero(begin)
        ends = np.append(at[1:], len(data))
        names, first, place = np.unique(RangeHash(data)(at, ends), return_index=True, return_inverse=True)
        values, wrong = self._values(names, data, at[first], ends[first])
        each = values.sizes[place]
        ids = values.take(place).pool
        bounds = np.searchsorted(at, starts)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        return ids, total(each), total(wrong[place])

    def _values(self, names: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Ragged, np.ndarray]:
        """Ids of segments by name (rising), and which of them the library corrected; what is not remembered is encoded."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        missing = np.flatnonzero(self.names[at] != names)
        values, wrong, every = self.known, self.wrong, at
        if len(missing):
            raw = data.tobytes()
            made, off = self.checked([raw[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)])
            every[missing] = len(self.names) + np.arange(len(missing))
            values, wrong = Ragged(np.concatenate([self.known.pool, made.pool]), np.concatenate([self.known.sizes, made.sizes])), np.concatenate([self.wrong, off])
        found = values.take(every), wrong[every]
        if len(missing) and self.remember:
            short = missing[ends[missing] - starts[missing] <= 64]
            if len(self.names) + len(short) > self.remember:  # begin anew with this batch's
                keep = np.flatnonzero(ends - starts <= 64)[: self.remember]
                self.names, self.known, self.wrong = np.append(np.uint64(0), names[keep]), _after_none(found[0].take(keep)), np.append(0, found[1][keep])
            else:
                places = np.concatenate([np.arange(len(self.names)), every[short]])
                together = np.concatenate([self.names, names[short]])
                order = np.argsort(together, kind="stable")
                self.names, self.known, self.wrong = together[order], values.take(places[order]), wrong[places[order]]
        return found

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts of rows of ids that lie end to end: without the one space that was put before a text; control pieces are nothing."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.pieces):
            raise ValueError("ids outside of the vocabulary")
        got = self.pieces.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1]
        raw = got.buffers()[2].to_pybytes() if len(ids) and got.buffers()[2] else b""
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and b > a) : b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def agreed(self, ids: np.ndarray, text: bytes) -> tuple[bytes, int]:
        """The text that the library gives for the ids of one row, and whether ``text`` differs from it; very long rows a piece at a time."""
        out, at = [], 0
        while at < len(ids) or not out:
            to = min(len(ids), at + CHECKED_IDS)
            while to < len(ids) and self.v.kinds[ids[to]] == BYTE:  # bytes of one character stay together
                to += 1
            ahead = [self.plain] if at else []
            got = self.library.decode(ahead + ids[at:to].tolist())
            out.append((got[len(self.v.pieces[self.plain]) :] if at else got).encode())
            at = max(to, 1)
        whole = b"".join(out)
        return whole, int(whole != text)


def _after_none(rows: Ragged) -> Ragged:
    return Ragged(rows.pool, np.append(0, rows.sizes))


def _boundaries(data: np.ndarray) -> np.ndarray:
    """Where segments begin inside of texts: at and after a line break, and at a space after anything but a space."""
    begin = np.zeros(len(data), bool)
    line, space = data == 10, data == 32
    begin |= line
    begin[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    return begin


def cuts(text: bytes, size: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a text of about ``size`` bytes, each up to a place where texts may be cut; one without such a place is one range."""
    at, n = 0, len(text)
    while n - at > size:
        line, space = text.rfind(b"\n", at + 1, at + size), text.rfind(b" ", at + 1, at + size)
        while space > at and text[space - 1 : space] == b" ":
            space -= 1
        to = max(line, space if space > at else -1)
        if to <= at:  # no place within the size: the next one after it
            line = text.find(b"\n", at + size)
            space = text.find(b" ", at + size)
            while 0 <= space and text[space - 1 : space] == b" ":
                space = text.find(b" ", space + 1)
            places = [x for x in (line, space) if x >= 0]
            if not places:
                break
            to = min(places)
        yield at, to
        at = to
    if at < n:
        yield at, n


def _parts(rows: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(row, part) of all texts; the first part has the space that the library puts before a text. Empty texts have none."""
    for row, text in enumerate(rows):
        text = text.replace(MARK.encode(), b" ")
        for a, b in cuts(text):
            yield row, text[a:b] if a else b" " + text[:b]


def encode_rows(codec: Codec, rows: list[bytes], end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of whole texts end to end, their numbers, and how many segments the library corrected."""
    found: list[list[np.ndarray]] = [[] for _ in rows]
    wrong = np.zeros(len(rows), np.int64)
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush():
        ids, sizes, off = codec.encode([p for _, p in group])
        at = 0
        for (row, _), n, w in zip(group, sizes.tolist(), off.tolist(), strict=True):
            found[row].append(ids[at : at + n])
            wrong[row] += w
            at += n

    for item in _parts(rows):
        group.append(item)
        held += len(item[1])
        if held >= TOGETHER:
            flush()
            group, held = [], 0
    if group:
        flush()
    tail = [np.array([codec.v.end], np.int32)] if end else []
    sizes = np.fromiter((sum(map(len, x)) + len(tail) for x in found), np.int64, len(rows))
    every = [a for x in found for a in (*x, *tail)]
    return np.concatenate(every) if every else np.zeros(0, np.int32), sizes, wrong


def encode(docs: DataFrame, model: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, ids array<int>, n_corrected.

    ``model``: a sentencepiece model file that every executor has. ``ids`` are those of the library for the whole text, without begin id or sampling, with
    the end id where ``end``. Null and empty texts have the end id alone; strings like ``</s>`` inside texts are text, as the library's default takes
    them; rows that repeat are encoded each; other columns are ignored; an empty table gives no rows. ``n_corrected``: segments of the row for which the
    agenda and the library differed (the library's ids are returned), 0 as far as known. Long texts are encoded part by part, cut where no piece reaches over.
    """

    def run(batches):
        codec = Codec(model)
        for batch in slices(batches):
            ids, sizes, wrong = encode_rows(codec, texts(batch), end)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(wrong, pa.int64())], ["doc_id", "ids", "n_corrected"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, schema(docs, ["doc_id"], "ids array<int>, n_corrected bigint"))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row, text, text_corrected: what the library's decode gives for ``ids``.

    Control pieces are nothing, bytes are put together; null or no ids give an empty text; an id that the vocabulary does not have is an error. Other
    columns are dropped. ``text_corrected``: 1 where the own text differed and the library's was taken, as for ids that no text has (parts of a character).
    """
    keep = keep or [c for c in rows.columns if c != ids_col]

    def run(batches):
        codec = Codec(model, remember=0)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                lists = part.column(part.num_columns - 1)
                sizes = np.array([n or 0 for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                agreed = [codec.agreed(ids[a:b], t) for a, b, t in zip(bounds[:-1].tolist(), bounds[1:].tolist(), codec.decode(ids, sizes), strict=True)]
                text = pa.array([t.decode("utf-8", "replace") for t, _ in agreed], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text, pa.array([w for _, w in agreed], pa.int64())], [*keep, "text", "text_corrected"])

    rows = rows.select(*keep, ids_col)
    return rows.mapInArrow(run, schema(rows, keep, "text string, text_corrected bigint"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document row: doc_id, n_tokens (end id included), ids_sha256, decoded_sha256, n_corrected, text_corrected."""
    ids = encode(docs, model)
    told = ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), "n_corrected", "ids")
    back = decode(told, model, keep=["doc_id", "n_tokens", "ids_sha256", "n_corrected"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "n_corrected", "text_corrected")
