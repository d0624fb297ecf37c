"""A linear-chain conditional random field over named features: fitted by gradient, decoded by Viterbi, both on padded batches."""

from __future__ import annotations

import numpy as np


class Chain:
    """weights [features, labels]; step [from, to]; first and last [labels]. A feature is a row of the weights; names that are not known have none."""

    def __init__(self, labels: list[str], names: list[str]):
        n = len(labels)
        self.labels, self.number = labels, {x: i for i, x in enumerate(names)}
        self.weights, self.step, self.first, self.last = np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n), np.zeros(n)

    def known(self, names: list[str]) -> list[int]:
        """Numbers of the features among ``names`` that are known."""
        return [i for x in names if (i := self.number.get(x)) is not None]

    def emissions(self, sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded scores [sequence, position, label] and the lengths."""
        lengths = np.array([len(s) for s in sequences])
        flat = np.array([f for s in sequences for t in s for f in t], np.int64)
        sizes = np.array([len(t) for s in sequences for t in s], np.int64)
        out = np.zeros((len(sequences), int(lengths.max(initial=0)), len(self.labels)))
        out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = self._sums(flat, sizes)
        return out, lengths

    def _sums(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of tokens whose features lie end to end; a token may have no known feature."""
        token, some = np.zeros((len(sizes), len(self.labels))), sizes > 0
        if some.any():
            token[some] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        return token

    def decode(self, sequences: list[list[list[int]]]) -> list[np.ndarray]:
        """Best label numbers of each non-empty sequence; sequences of similar length share a batch."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            longest, to = len(sequences[order[at]]) * 2 + 8, at
            while to < len(order) and to - at < 2048 and len(sequences[order[to]]) <= longest:
                to += 1
            for i, path in zip(order[at:to], self._viterbi([sequences[i] for i in order[at:to]]), strict=True):
                out[i] = path
            at = to
        return out

    def _viterbi(self, sequences: list[list[list[int]]]) -> list[np.ndarray]:
        e, lengths = self.emissions(sequences)
        path = self._best(e, lengths, self.first, self.last)
        return [p[:m] for p, m in zip(path, lengths, strict=True)]

    def certain_cuts(self, e: np.ndarray, at: np.ndarray):
        """(labels, token numbers) of all tokens that need not have the first label on the best paths of many texts.

        ``e`` [token, label] holds the scores of texts end to end, ``at`` where each begins and the number of tokens. A token whose
        first label beats every other by more than the greatest gain from the transitions on both sides has that label on the best
        path, whatever its neighbours have. Runs of other tokens, between two such or the ends of a text, are searched by
        themselves, many of similar length at a time.
        """
        n, k = e.shape
        # with another label instead, the two transitions around a token can gain so much at most
        into, out = np.vstack([self.step, self.first]), np.hstack([self.step, self.last[:, None]])
        gain = (into[:, 1:] - into[:, :1]).max(initial=-np.inf, axis=0) + (out[1:] - out[:1]).max(initial=-np.inf, axis=1)
        open_ = (e[:, 1:] + gain >= e[:, :1]).any(axis=1)
        where = np.flatnonzero(open_)
        if not len(where):
            return
        head = np.zeros(n + 1, bool)
        head[at] = True
        new = np.append(True, (np.diff(where) > 1) | head[where[1:]])
        begin = where[new]
        length = np.diff(np.append(np.flatnonzero(new), len(where)))
        order = np.argsort(length, kind="stable")
        a = 0
        while a < len(order):
            longest, b = int(length[order[a]]) * 2 + 8, a
            most = max(1, 100_000 // longest)
            b = a + int(np.searchsorted(length[order[a : a + most]], longest, side="right"))
            some = order[a:b]
            size = length[some]
            t = np.arange(int(size.max()))
            inside = t[None, :] < size[:, None]
            token = np.minimum(begin[some][:, None] + t[None, :], n - 1)
            enter = np.where(head[begin[some]][:, None], self.first, self.step[0])
            leave = np.where(head[begin[some] + size][:, None], self.last, self.step[:, 0])
            path = self._best(e[token].astype(np.float64), size, enter, leave)
            yield path[inside], token[inside]
            a = b

    def _best(self, e: np.ndarray, lengths: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Best label numbers [sequence, position]; scores for the first and the last label of each sequence are given."""
        n, t_max, k = e.shape
        back = np.zeros((t_max, n, k), np.int8)
        v = e[:, 0] + enter
        for t in range(1, t_max):
            every = v[:, :, None] + self.step[None]
            back[t] = every.argmax(axis=1)
            v = np.where((t < lengths)[:, None], every.max(axis=1) + e[:, t], v)
        path = np.zeros((n, t_max), np.int8)
        now = (v + leave).argmax(axis=1)
        rows = np.arange(n)
        for t in range(t_max - 1, -1, -1):
            path[:, t] = now
            now = np.where((t > 0) & (t < lengths), back[t, rows, now], now)
        return path

    def fit(self, sequences: list[list[list[int]]], gold: list[list[int]], ridge: float = 0.02, rounds: int = 150, rate: float = 0.5) -> Chain:
        """Maximum likelihood with a ridge, by scaled gradient steps (the scale of each weight follows its own past)."""
        n, k = len(sequences), len(self.labels)
        t_max = max(map(len, sequences))
        lengths = np.array([len(s) for s in sequences])
        flat = np.array([f for s in sequences for t in s for f in t])
        sizes = np.array([len(t) for s in sequences for t in s], np.int64)
        token = np.repeat(np.arange(lengths.sum()), sizes)
        inside = np.arange(t_max)[None, :] < lengths[:, None]
        y = np.zeros((n, t_max), int)
        y[inside] = [v for g in gold for v in g]
        one = np.eye(k)[y] * inside[:, :, None]
        pairs = np.zeros((k, k))
        for g in gold:
            np.add.at(pairs, (g[:-1], g[1:]), 1)
        rows, ends = np.arange(n), lengths - 1
        params = [self.weights, self.step, self.first, self.last]
        past = [np.full(p.shape, 1e-8) for p in params]

        def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

        for r in range(rounds):
            pace = rate * 0.1 * min(1.0, 2 * (1 - r / rounds))  # steps get shorter in the second half, so that it settles
            e = np.zeros((n, t_max, k))
            e[inside] = self._sums(flat, sizes)
            f = np.zeros((n, t_max, k))
            f[:, 0] = e[:, 0] + self.first
            for t in range(1, t_max):
                f[:, t] = np.where(inside[:, t, None], log_sum(f[:, t - 1, :, None] + self.step[None], 1) + e[:, t], f[:, t - 1])
            z = log_sum(f[rows, ends] + self.last, 1)
            b = np.zeros((n, t_max, k))
            b[:] = self.last
            p_step = np.zeros((k, k))
            for t in range(t_max - 2, -1, -1):
                inner = e[:, t + 1] + b[:, t + 1]
                b[:, t] = np.where((t + 1 < lengths)[:, None], log_sum(self.step[None] + inner[:, None, :], 2), self.last)
                both = f[:, t, :, None] + self.step[None] + inner[:, None, :] - z[:, None, None]
                p_step += np.exp(both[t + 1 < lengths]).sum(axis=0)
            p = np.exp(f + b - z[:, None, None]) * inside[:, :, None]
            rest = (p - one)[inside]
            g_w = np.stack([np.bincount(flat, rest[token, j], len(self.weights)) for j in range(k)], axis=1)
            grads = [g_w, p_step - pairs, (p - one)[:, 0].sum(axis=0), (p - one)[rows, ends].sum(axis=0)]
            for param, g, s in zip(params, grads, past, strict=True):
                g = g + ridge * param
                s *= 0.9
                s += 0.1 * g * g
                param -= pace * g / np.sqrt(s)
        return self
