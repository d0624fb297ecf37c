"""Language identification in two steps: the family, then the language among close relatives.

Features are counts of hashed byte n-grams of the lower-cased letters of a whole text, square-rooted and
scaled to length one. Both steps are linear support vector machines: the first, over language families, one against the
rest; then inside each family one machine for each pair of its languages, trained on these two only. Each machine gives one of its two a vote; most
votes win, and of equals the greatest sum of margins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import joined, schema, slices, texts
from quern.llm._sample import by_hash, fold

#: Labelled rows used for fitting, in all and of each language at most.
SAMPLE, SAMPLE_EACH = 2400, 600
#: Hashed n-gram features.
FEATURES = 4096
UNKNOWN = "und"

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"),
}


def family(lang: str) -> str:
    """The family of a language code (its part before ``-`` or ``_``); an unlisted language is a family of its own."""
    code = regex.split("[-_]", lang.lower())[0]
    return next((k for k, v in FAMILIES.items() if code in v), "other " + lang)


_LETTER = regex.compile(r"\p{L}")
_U32 = np.uint32
#: Bytes that count: letters and parts of longer characters; the rest is white space.
_LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(rows: list[bytes]) -> np.ndarray:
    """One row of FEATURES values for each text: hashed n-grams of one to four bytes."""
    data, starts = joined([b" " + t.decode().lower().encode() for t in rows], b" ")
    x = _LETTERS[data]
    gap = np.zeros(len(x), bool)  # white space after white space says nothing
    if len(x):
        gap[1:] = (x[1:] == 32) & (x[:-1] == 32)
    gap[starts[:-1]] = False
    kept = np.flatnonzero(~gap)
    x = x[kept].astype(_U32)
    at = np.searchsorted(kept, starts)
    out = np.zeros((len(rows), FEATURES), np.float32)
    n = len(x)
    grams = []
    h = np.zeros(n, _U32)
    for k in range(4):
        h = h * _U32(0x01000193) if k else h
        h = h[: n - k] + (x[k:] + _U32(1)) * _U32(0x9E3779B1)
        if k:
            grams.append(((h ^ (h >> _U32(15))) * _U32(0x85EBCA6B) >> _U32(20)).astype(np.int64))
    for i in range(len(rows)):
        a, b = int(at[i]), int(at[i + 1])
        counts = np.zeros(FEATURES)
        for k, g in enumerate(grams, 1):
            if b - k > a:
                counts += np.bincount(g[a : b - k], minlength=FEATURES)
        np.sqrt(counts, out=counts)
        size = np.sqrt((counts * counts).sum())
        if size:
            out[i] = counts / size
    return out


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 80) -> np.ndarray:
    """Weights (last: bias) of a linear machine with squared hinge loss, y of +1 and -1, both signs weighing the same."""
    n, m = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x = np.hstack([x, np.ones((n, 1), np.float32)])
    w = v = np.zeros(m + 1, np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        g = -2 * (x.T @ (weight * slack * y)) + ridge * v
        new = v - 0.2 * g
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """families: names; members: languages of each; machines: one matrix for families, a row each; pairs: for each family a row for each pair (i, j), i < j, of its members, in order."""

    families: list[str]
    members: list[list[str]]
    machines: np.ndarray
    pairs: list[np.ndarray]

    def _family(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best of the families and its share of the softmax of all margins."""
        z = 3 * (x @ self.machines[:, :-1].T + self.machines[:, -1])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return z.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)

    def _vote(self, x: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The member of family ``f`` with most votes (then the greatest sum of margins), and its share: the mean of its chances in its pairs."""
        n, w = len(self.members[f]), self.pairs[f]
        margin = x @ w[:, :-1].T + w[:, -1]
        votes, sums, chance = (np.zeros((len(x), n)) for _ in range(3))
        for k, (i, j) in enumerate(combinations(range(n), 2)):
            m = margin[:, k]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
            p = 1 / (1 + np.exp(-6 * np.clip(m, -5, 5)))
            chance[:, i] += p
            chance[:, j] += 1 - p
        top = votes == votes.max(axis=1, keepdims=True)
        best = np.where(top, sums, -np.inf).argmax(axis=1)
        return best, chance[np.arange(len(x)), best] / max(1, n - 1)

    def predict(self, rows: list[bytes]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(rows), [0.0] * len(rows)
        full = [i for i, t in enumerate(rows) if _LETTER.search(t.decode())] if self.families else []
        if not full:
            return langs, scores
        x = features([rows[i] for i in full])
        best, share = self._family(x)
        for f in range(len(self.families)):
            mine = np.flatnonzero(best == f)
            if not len(mine):
                continue
            if len(self.members[f]) == 1:
                own, part = np.zeros(len(mine), int), np.ones(len(mine))
            else:
                own, part = self._vote(x[mine], f)
            for k, o, p in zip(mine.tolist(), own.tolist(), part.tolist(), strict=True):
                langs[full[k]], scores[full[k]] = self.members[f][o], float(share[k] * p)
        return langs, scores


def _against_rest(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.append(np.zeros(x.shape[1], np.float32), np.float32(1))[None, :]
    if n == 2:  # each is the rest of the other
        w = svm(x, np.where(of == 0, 1, -1).astype(np.float32))
        return np.stack([w, -w])
    return np.stack([svm(x, np.where(of == k, 1, -1).astype(np.float32)) for k in range(n)])


def fit_features(x: np.ndarray, langs: list[str]) -> Model:
    """Machines of both steps from feature rows and their languages."""
    names = sorted(set(langs))
    families = sorted({family(v) for v in names})
    members = [[v for v in names if family(v) == f] for f in families]
    of = np.array([families.index(family(v)) for v in langs], int)
    machines = _against_rest(x, of, len(families)) if families else np.zeros((0, x.shape[1] + 1), np.float32)
    pairs = []
    for own in members:
        rows = {v: np.flatnonzero(np.array([w == v for w in langs])) for v in own}
        made = []
        for a, b in combinations(own, 2):
            both = np.concatenate((rows[a], rows[b]))
            made.append(svm(x[both], np.repeat(np.array([1, -1], np.float32), (len(rows[a]), len(rows[b])))))
        pairs.append(np.stack(made) if made else np.zeros((0, x.shape[1] + 1), np.float32))
    return Model(families, members, machines, pairs)


def fit(docs: DataFrame, each: int = SAMPLE_EACH, total: int = SAMPLE) -> Model:
    """Fit on text and non-null lang of rows whose fold is not 0: about ``each`` of a language at most, ``total`` in all, rare languages whole.

    Each sampled text also gives one of its lines as a short example.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang").filter("lang is not null and doc_id is not null").filter(fold() != 0)
    chosen = by_hash(named, "lang", each, total).select("doc_id").distinct()  # at most `total` ids

    def run(batches):
        for batch in slices(batches):
            rows = texts(batch)
            keep = [i for i, t in enumerate(rows) if _LETTER.search(t.decode())]
            rows, langs = [rows[i] for i in keep], batch.column(0).take(pa.array(keep, pa.int64()))
            ids = batch.column(1).take(pa.array(keep, pa.int64()))
            short = [(lines := t.split(b"\n"))[len(lines) // 2] for t in rows]
            for kind, part in ((0, rows), (1, short)):
                made = [f.astype(np.float16).tobytes() for f in features(part)]
                yield pa.RecordBatch.from_arrays([langs, ids, pa.array([kind] * len(part), pa.int32()), pa.array(made, pa.binary())], ["lang", "doc_id", "kind", "x"])

    seen = docs.select("lang", F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("lang is not null").join(F.broadcast(chosen), "doc_id").select("lang", "doc_id", "text")
    rows = seen.mapInArrow(run, "lang string, doc_id bigint, kind int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["kind"], r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES), np.float32)
    return fit_features(x, [r["lang"] for r in rows])


def language_id(docs: DataFrame, each: int = SAMPLE_EACH, total: int = SAMPLE) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred (a learned value, or ``und`` without any letter), score from 0 to 1.

    Whole texts are read; lang, source and doc_id are no inputs of a prediction. Null, empty and letterless texts
    get ``und`` and 0; so does every text when there is nothing to learn from. Repeated rows are predicted
    one by one; a null doc_id is predicted, and held_out is null.
    """
    model = fit(docs, each, total)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # families and pairs of languages by FEATURES numbers

    def run(batches):
        for batch in slices(batches):
            langs, scores = shared.value.predict(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    plain = docs.select("doc_id", "text")
    found = plain.mapInArrow(run, schema(plain, ["doc_id"], "lang_pred string, score double"))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
