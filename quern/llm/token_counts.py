"""Token counts by the sentencepiece library, one Arrow function that returns lengths only.

No piece of a BPE vocabulary with the word mark only at its front, and none with a line break, can
span a space that follows a non-space or a line break. Texts are split there, batches hold
a bounded number of bytes, and each distinct segment of a batch is encoded once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import joined, schema, slices, texts
from quern.llm._segments import Remembered
from quern.llm.piece_codec import cuts

LIMIT = 4096
#: Bytes of a text that are looked at together, where it has a place to be cut.
PART_BYTES = 1 << 19
_MARK = "▁"


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    splits = not any("\n" in p or " " in p or _MARK in p.lstrip(_MARK) for p in pieces)
    probe = "a ﬁ½  B́\tc　\n"
    same = library.normalize(probe) == _MARK + probe.replace(" ", _MARK) if hasattr(library, "normalize") else False
    return library, splits and same


def _boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments begin at each row, at a line break and at a space after anything but a space."""
    begin = np.zeros(len(data), bool)
    space = data == 32
    begin[1:] = space[1:] & ~space[:-1]
    begin |= data == 10
    begin[starts[:-1]] = True
    at = np.flatnonzero(begin)
    return at, np.append(at[1:], len(data))


class Counter:
    """Counts of whole texts as the library gives them."""

    def __init__(self, path: str):
        self.library, self.splits = _library(path)
        self.segments = Remembered(self._segments)

    def _segments(self, parts: list[bytes]) -> list[int]:
        # the library puts one space before what it encodes: a segment's own first space stands for it
        ids = self.library.encode([(p[1:] if p[:1] == b" " else p).decode() for p in parts], num_threads=1)
        return [1 if p == b" " else len(x) if p[:1] == b" " else len(x) - 1 for p, x in zip(parts, ids, strict=True)]

    def __call__(self, rows: list[bytes]) -> np.ndarray:
        """Counts of whole texts; long ones part by part, so that what is held beside a text does not grow with it."""
        long = [i for i, t in enumerate(rows) if len(t) > PART_BYTES and self._fast(t)]
        if not long:
            return self._counts(rows)
        out = self._counts([b"" if i in set(long) else t for i, t in enumerate(rows)])
        for i in long:
            for a, b in cuts(rows[i], PART_BYTES):
                part = rows[i][a:b]
                # the space put before a text: a later part's own one stands for it, before a line break it is one token too many
                own = a > 0 and part[:1] == b" "
                out[i] += 1 if own and len(part) == 1 else self._counts([part[1:] if own else part])[0] - (a > 0 and part[:1] == b"\n")
        return out

    def _fast(self, text: bytes) -> bool:
        return self.splits and b"\xe2\x96\x81" not in text and b"\0" not in text

    def _counts(self, rows: list[bytes]) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        fast, slow = [], []
        for i, t in enumerate(rows):
            if t:
                (fast if self._fast(t) else slow).append(i)
        if slow:
            out[slow] = [len(x) for x in self.library.encode([rows[i].decode() for i in slow], num_threads=1)]
        if fast:
            data, starts = joined([b" " + rows[i] for i in fast])
            begin, end = _boundaries(data, starts)
            values, place = self.segments(data, begin, end)
            counts = np.asarray(values, np.int64)[place]
            out[fast] = np.add.reduceat(counts, np.searchsorted(begin, starts[:-1]))
        return out


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``model``: a sentencepiece model file that every executor has. No begin, end or other added
    tokens; special strings inside texts as the library's default takes them. Null and empty texts count 0,
    repeated rows are counted one by one, other columns are ignored. Texts with the word mark itself
    or a zero byte are encoded whole, other long ones part by part.
    """

    def run(batches):
        count = Counter(model)
        for batch in slices(batches):
            n = count(rows := texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, schema(docs, ["doc_id"], "n_bytes bigint, n_tokens bigint, over_limit boolean"))
