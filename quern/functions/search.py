"""Many strings sought in many texts at once, in numpy: a few bytes of memory for each string, no object for a string or a place.

Strings are grouped by length. A place of a text is looked at for a length only if a table says that some string of that length
begins with the bytes found there; then a hash of so many bytes is looked up, and the bytes themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Bits of a table's index; prefixes that tables are over; bytes of text looked at together.
TABLE_BITS, PREFIXES, PART_BYTES = 20, (8, 4, 2, 1), 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _scattered(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class _Hashes:
    """Hashes of any ranges of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _powers(_P, len(data)), out=self.sums[1:])
        self.back = _powers(_P_INV, len(data) + 1)

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        return _scattered((self.sums[at + length] - self.sums[at]) * self.back[at])


class Strings:
    """Strings to be sought, not empty and each once; a string's number is its place in the list given."""

    def __init__(self, strings: list[bytes]):
        self.n = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, self.n)
        self.longest = int(sizes.max()) if self.n else 0
        self.tables = {w: None for w in PREFIXES}
        self.lengths: dict[int, list[tuple]] = {w: [] for w in PREFIXES}
        for length in np.unique(sizes).tolist():
            numbers = np.flatnonzero(sizes == length)
            body = np.frombuffer(b"".join(strings[i] for i in numbers.tolist()), np.uint8)
            at = np.arange(len(numbers)) * length
            hashes = _Hashes(body)
            whole = hashes(at, length)
            order = np.argsort(whole, kind="stable")
            w = next(w for w in PREFIXES if w <= length)
            self.lengths[w].append((length, whole[order], numbers[order], body.reshape(-1, length)[order]))
            if self.tables[w] is None:
                self.tables[w] = np.zeros(1 << TABLE_BITS, U64)
            # one bit for each length, the last one for all longer ones
            np.bitwise_or.at(self.tables[w], (hashes(at, w) >> U64(64 - TABLE_BITS)).astype(np.int64), U64(1) << U64(min(length, 63)))

    def found(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of strings that occur in rows of ``data``, each pair once; ``starts``: the n + 1 offsets of the rows."""
        hashes, total = _Hashes(data), len(data)
        row_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        out = []
        for w, table in self.tables.items():
            if table is None or total < w:
                continue
            at = np.arange(total - w + 1)
            bits = table[(hashes(at, w) >> U64(64 - TABLE_BITS)).astype(np.int64)]
            at = np.flatnonzero(bits)
            bits = bits[at]
            for length, known, numbers, bodies in self.lengths[w]:
                here = at[(bits >> U64(min(length, 63))) & U64(1) == 1]
                here = here[here + length <= starts[row_of[here] + 1]]
                if not len(here):
                    continue
                h = hashes(here, length)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                here, place = here[hit], place[hit]
                pairs = np.unique(row_of[here] * np.int64(len(known)) + place, return_index=True)[1]
                here, place = here[pairs], place[pairs]
                same = np.concatenate([(data[here[i : i + 4096, None] + np.arange(length)] == bodies[place[i : i + 4096]]).all(1) for i in range(0, len(here), 4096)]) if len(here) else np.zeros(0, bool)
                out.append(row_of[here[same]] * np.int64(self.n) + numbers[place[same]])
        both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return both // max(1, self.n), both % max(1, self.n)

    def search(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``found`` over texts of any length, some bytes at a time; a long text is cut into parts that overlap by the longest string."""
        if not self.n:
            return
        parts: list[bytes] = []
        rows: list[int] = []
        held = 0

        def flush():
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            row, number = self.found(np.frombuffer(b"".join(parts), np.uint8), starts)
            return np.array(rows)[row], number

        for row, text in enumerate(texts):
            for a in range(0, max(1, len(text)), PART_BYTES):
                parts.append(text[a : a + PART_BYTES + self.longest - 1])
                rows.append(row)
                held += len(parts[-1])
                if held >= PART_BYTES:
                    yield flush()
                    parts, rows, held = [], [], 0
        if parts:
            yield flush()
