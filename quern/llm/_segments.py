"""Token sequences of text segments, remembered by hash.

Both vocabularies used here never join symbols across certain boundaries, so a text's tokens are
the tokens of its segments in order. Segments are hashed for a whole batch at once, each distinct
segment is looked up once, and only unseen ones reach the tokenizer. The memory of seen segments is
bounded: two generations, of which the older is dropped when the younger is full. That changes speed only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quern.llm._bytes import RangeHash

REMEMBER = 500_000
#: Segments longer than this are not kept in memory.
KEEP_BYTES = 64


class Remembered:
    """encode(list of segments) -> list of values, with a bounded memory; ``remember`` 0: distinct within a batch only."""

    def __init__(self, encode: Callable[[list[bytes]], list], remember: int = REMEMBER):
        self.encode, self.half, self.young, self.old = encode, remember // 2, {}, {}

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, np.ndarray]:
        """Values of the distinct segments, and for each segment the place of its value."""
        keys = RangeHash(data)(starts, ends)
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if not self.half:
            raw = data.tobytes()
            return self.encode([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]), place.reshape(-1)
        names = distinct.tolist()
        values = list(map(self.young.get, names))
        missing = []
        for i in [i for i, v in enumerate(values) if v is None]:
            if (v := self.old.get(names[i])) is None:
                missing.append(i)
            else:
                values[i] = v
                self._keep(names[i], v)
        if missing:
            raw = data.tobytes()
            at = first[missing]
            parts = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            for i, part, v in zip(missing, parts, self.encode(parts), strict=True):
                values[i] = v
                if len(part) <= KEEP_BYTES:
                    self._keep(names[i], v)
        return values, place.reshape(-1)

    def _keep(self, name: int, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[name] = value
