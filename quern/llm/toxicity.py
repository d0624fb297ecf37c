"""Toxicity by weak supervision.

Voters look at a whole text and vote for one class or abstain. Some are patterns fixed below: word lists, second person near a listed
word, shouting, repeated marks, stretched letters, politeness, nothing of all that. The others are a lexicon of both classes: words and word beginnings of four to
eight bytes that are common in one class of a bounded sample of labelled rows and rare in the other. A generative model of the votes (hidden
class; each voter's firing rate by class, and by whether its neighbour in a tree of correlated voters fires; the sample's labels as noisy
votes of their own) is fitted to the likelihood of all votes by expectation maximisation. A logistic regression over the same voters is trained on the
posterior labels; it scores every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import RangeHash, class_table, joined, mix, schema, slices, texts, words
from quern.llm._sample import by_hash, fold
from quern.state import cut, forget

#: Labelled rows used for fitting: of each class, and in all.
SAMPLE_EACH, SAMPLE = 4000, 8000
#: Evidence (twice the log likelihood ratio) from which a word may be a voter: beyond chance among some 100,000 of them.
EVIDENCE = 22.0
#: A word that votes fires so many times as often in its class as in the other, at least, and in so many rows of it.
PURITY, LEAST = 40.0, 3
#: Evidence from which two voters count as correlated within the classes.
CORRELATED = 12.0
#: A pattern is a hash of so many bits; a table over its first COARSE bits tells most others from voters.
BITS, COARSE = 32, 20
PREFIXES = (4, 5, 6, 7, 8)

#: Word lists, written for this operator (English, German, French, Spanish).
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb fool fools loser losers pathetic worthless scum clown clowns "
    "imbecile imbeciles cretin disgusting filthy vermin hateful liar liars coward cowards "
    "dummkopf trottel vollidiot idioten arschloch versager abschaum widerlich ekelhaft feigling "
    "idiote idiotes imbécile crétin abruti connard stupide minable débile "
    "idiota imbécil estúpido estúpida tonto tonta cretino patético asqueroso cobarde inútil"
).split()
SECOND_PERSON = "you your yours yourself youre u ya du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos ti tú usted ustedes vosotros su sus".split()
POLITE = "please thanks thank welcome sorry grateful appreciate bitte danke dankbar entschuldigung merci pardon désolé gracias disculpe perdón favor".split()
#: The pattern voters; their places are their pattern numbers.
FIXED = ("listed word", "two listed words", "second person near a listed word", "shouting", "repeated marks", "stretched letters", "politeness", "nothing of all that")

_U = np.uint64
#: Words: letters, digits and all bytes of longer characters.
_INSIDE = class_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


def _hashes(of: list[str]) -> np.ndarray:
    data, starts = joined([w.encode() for w in of])
    return np.unique(RangeHash(data)(starts[:-1], starts[1:]))


_INSULT, _YOU, _POLITE = map(_hashes, (INSULTS, SECOND_PERSON, POLITE))


def _fixed(n: int, raw: list[bytes], names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and rows of the fixed patterns that fire; ``names``: hashes of all words, ``row``: whose they are."""
    listed = np.isin(names, _INSULT)
    count = np.bincount(row[listed], minlength=n)
    you = np.isin(names, _YOU)
    near = np.zeros(len(names), bool)  # a second person among the four words before or the two after
    for d in (-4, -3, -2, -1, 1, 2):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        near[a] |= you[b] & (row[a] == row[b])
    both = np.bincount(row[near & listed], minlength=n) > 0
    polite = np.bincount(row[np.isin(names, _POLITE)], minlength=n) > 0
    shout, marks, long = (np.zeros(n, bool) for _ in range(3))
    data, starts = joined(raw, b" ")
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    ups, lows = (np.add.reduceat(x, starts[:-1], dtype=np.int64) if n else np.zeros(0, np.int64) for x in (upper, lower))
    shout = (ups + lows >= 20) & (ups >= 0.6 * (ups + lows))
    of = lambda at: np.searchsorted(starts, at, side="right") - 1
    mark = (data == 33) | (data == 63)
    marks[of(np.flatnonzero(mark[1:] & mark[:-1]))] = True
    letter = upper | lower
    same = letter[1:] & (data[1:] == data[:-1])
    long[of(np.flatnonzero(same[2:] & same[1:-1] & same[:-2]))] = True
    fires = [count > 0, count > 1, both, shout, marks, long, polite]
    fires.append(~np.logical_or.reduce(fires[:6]))
    at = [np.flatnonzero(x) for x in fires]
    return np.repeat(np.arange(len(fires)), [len(x) for x in at]), np.concatenate(at)


def patterns(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pattern numbers (with repeats) and the row of each: the fixed ones, words, and word beginnings of the lower-cased texts."""
    data, starts = joined([t.decode().lower().encode() for t in rows], b" ")
    begin, end = words(data, _INSIDE)
    row = np.searchsorted(starts, begin, side="right") - 1
    h = RangeHash(data)
    names = h(begin, end) if len(begin) else np.zeros(0, np.uint64)
    fixed, fixed_row = _fixed(len(rows), rows, names, row)
    shift = _U(64 - BITS)
    out, of = [fixed.astype(np.uint64), names >> shift], [fixed_row, row]
    length = end - begin
    for k in PREFIXES:
        long = np.flatnonzero(length > k)
        b = begin[long]
        out.append(mix(h(b, b + k) + _U(k)) >> shift)
        of.append(row[long])
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    """keys: the patterns that count, rising; weights: of each; bias; voters: what the label model found (pattern, rates in class 1 and 0, the voter it depends on or -1)."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    voters: list[tuple[int, float, float, int]]

    def __post_init__(self):
        self.coarse = np.zeros(1 << COARSE, bool)
        self.coarse[self.keys >> (BITS - COARSE)] = True

    def scores(self, rows: list[bytes]) -> np.ndarray:
        """Probability of the toxic class for each text; distinct patterns count once."""
        z = np.full(len(rows), self.bias)
        found, of = patterns(rows)
        hit = np.flatnonzero(self.coarse[found >> (BITS - COARSE)])
        if len(hit):
            pair = np.unique(of[hit] << BITS | found[hit])
            key = pair & (1 << BITS) - 1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            np.add.at(z, pair >> BITS, np.where(self.keys[at] == key, self.weights[at], 0.0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _constant(rate: float) -> Model:
    return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))), [])


def _products(votes: np.ndarray, weight: np.ndarray, block: int = 256):
    """(first column, weighted counts of rows in which each voter of a block fires together with each voter)."""
    for a in range(0, votes.shape[1], block):
        some = votes[:, a : a + block].astype(np.float32) * weight[:, None].astype(np.float32)
        out = np.empty((some.shape[1], votes.shape[1]))
        for b in range(0, votes.shape[1], 2048):
            out[:, b : b + 2048] = some.T @ votes[:, b : b + 2048].astype(np.float32)
        yield a, out


def _information(n: float, x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """n times the mutual information of pairs of events that happen x, y and both times of n."""
    out = np.zeros_like(both)
    for p, q, r in ((x, y, both), (n - x, y, y - both), (x, n - y, x - both), (n - x, n - y, n - x - y + both)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(r > 1e-6, r * np.log(r * n / np.maximum(p * q, 1e-9)), 0)
    return out


def tree(votes: np.ndarray, post: np.ndarray, least: float = CORRELATED) -> np.ndarray:
    """The voter that each voter depends on, or -1: a forest of the greatest mutual information within the classes.

    Only pairs with that much evidence (twice the log likelihood ratio against independence) count. Of all forests this one has the
    greatest likelihood of the votes given the classes.
    """
    m = votes.shape[1]
    edges: list[tuple[float, int, int]] = []
    totals = [(w.sum(), votes.T.astype(np.float32) @ w.astype(np.float32)) for w in (post, 1 - post)]
    for (a, both1), (_, both0) in zip(_products(votes, post), _products(votes, 1 - post), strict=True):
        gain = np.zeros_like(both1)
        for (n, k), both in zip(totals, (both1, both0), strict=True):
            k = k.astype(np.float64)
            gain += 2 * _information(n, k[a : a + len(both)][:, None], k[None, :], both)
        i, j = np.nonzero(gain > least)
        keep = j > i + a
        edges += zip((-gain[i[keep], j[keep]]).tolist(), (i[keep] + a).tolist(), j[keep].tolist(), strict=True)
    top = list(range(m))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    near: list[list[int]] = [[] for _ in range(m)]
    for _, i, j in sorted(edges):
        p, q = find(i), find(j)
        if p != q:
            top[p] = q
            near[i].append(j)
            near[j].append(i)
    parent = np.full(m, -1)
    seen = np.zeros(m, bool)
    for root in np.argsort(-votes.sum(axis=0), kind="stable").tolist():
        line = [] if seen[root] else [root]
        seen[root] = True
        while line:
            x = line.pop()
            for y in near[x]:
                if not seen[y]:
                    seen[y], parent[y] = True, x
                    line.append(y)
    return parent


def label_model(votes: np.ndarray, seed: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row; firing rates of voters in class 1 and 0; the voter that each depends on, or -1.

    votes: rows by voters, 1 where a voter votes, 0 where it abstains. seed: the labels, a further voter whose error rates are estimated as well.
    A voter that depends on another has two firing rates in each class: for rows where that one fires, and for the others. Rates and
    classes are fitted to the likelihood of all votes; the forest of dependences is found anew every ten rounds.
    """
    n, m = votes.shape
    x = votes.astype(np.float32)
    post = np.where(seed > 0, 0.95, 0.05)
    parent = np.full(m, -1)
    a = b = np.zeros(m)
    for step in range(rounds):
        if m and step in (5, 15, 25):
            parent = tree(votes, post)
            other = np.where(parent[None, :] >= 0, x[:, np.maximum(parent, 0)], 0)
            pair = x * other
        elif not step:
            other = pair = np.zeros((n, 0), np.float32)
        one, zero = post.sum(), n - post.sum()
        prior = (one + 1) / (n + 2)
        z = np.full(n, np.log(prior / (1 - prior)))
        rates = []
        for w, size in ((post, one), (1 - post, zero)):
            fired = w @ x
            overall = np.clip((fired + 0.02) / (size + 1), 1e-5, 1 - 1e-5)
            if len(pair[0]) if n else 0:
                with_other, both = w @ other, w @ pair
                beside = np.clip((both + overall) / (with_other + 1), 1e-5, 1 - 1e-5)
                without = np.clip((fired - both + overall) / (size - with_other + 1), 1e-5, 1 - 1e-5)
                without, beside = np.where(parent < 0, overall, without), np.where(parent < 0, overall, beside)
            else:
                beside = without = overall
            rates.append((overall, beside, without))
        (a, a1, a0), (b, b1, b0) = rates
        # log of (fires, abstains) given that the other fires or not, class 1 against class 0
        z += (np.log1p(-a0) - np.log1p(-b0)).sum() + x @ (np.log(a0 / b0) - np.log1p(-a0) + np.log1p(-b0))
        if len(pair[0]) if n else 0:
            silent = (np.log1p(-a1) - np.log1p(-b1)) - (np.log1p(-a0) - np.log1p(-b0))
            loud = np.log(a1 / b1) - np.log(a0 / b0)
            z += other @ silent + pair @ (loud - silent)
        label_1 = np.clip((post @ seed + 1) / (one + 2), 0.5, 0.995)
        label_0 = np.clip(((1 - post) @ seed + 1) / (zero + 2), 0.005, 0.5)
        z += np.where(seed > 0, np.log(label_1 / label_0), np.log((1 - label_1) / (1 - label_0)))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-4 and step > 25:
            break
    return post, a, b, parent


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; both classes weigh the same in all, the ridge is on the weights only."""
    n, m = x.shape
    x = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float32)
    weight = np.where(y > 0.5, 0.5 * n / max(1, (y > 0.5).sum()), 0.5 * n / max(1, (y <= 0.5).sum()))
    w, penalty = np.zeros(m + 1), np.full(m + 1, ridge * 10)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-4)).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(bend.astype(np.float64) + np.diag(penalty), slope)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w[:-1], float(w[-1])


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts that err least against the posterior labels, errors of both kinds counted by row."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order] > 0
    missed = np.append(0, np.cumsum(y))  # toxic rows below cut i
    wrong = np.append(np.cumsum(~y[::-1])[::-1], 0)  # clean rows from cut i on
    errors = missed + wrong
    edge = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    gap = np.where(errors == errors.min(), edge[1:] - edge[:-1], -1.0)
    i = int(np.argmax(gap))
    return float((edge[i] + edge[i + 1]) / 2)


def _evidence(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """Twice the log likelihood ratio of a word's counts against equal rates in both classes."""
    total = toxic + clean
    part = lambda k, share: F.when(k > 0, k * F.log(k / (total * F.lit(share)))).otherwise(F.lit(0.0))
    return 2 * (part(toxic, n1 / (n1 + n0)) + part(clean, n0 / (n1 + n0)))


def fit_votes(keys: np.ndarray, fires: list[np.ndarray], labels: np.ndarray) -> Model:
    """From voters' patterns, the places in ``keys`` that fire on each sampled row, and the rows' labels."""
    n = len(labels)
    on: list[list[int]] = [[] for _ in keys]
    for i, row in enumerate(fires):
        for k in row.tolist():
            on[k].append(i)
    # of words that fire on the same rows (beginnings of one word) only the first is a voter
    first: dict[tuple, int] = {}
    for k, rows in enumerate(on):
        if rows:
            first.setdefault((int(keys[k]) if keys[k] < len(FIXED) else -1, *rows), k)
    places = sorted(first.values())
    if not places:
        return _constant(float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)))
    votes = np.zeros((n, len(places)), np.uint8)
    for j, k in enumerate(places):
        votes[on[k], j] = 1
    post, a, b, parent = label_model(votes, labels.astype(float))
    x = votes.astype(np.float32)
    w, bias = _regression(x, post)
    bias -= min(0.0, _threshold(x @ w + bias, post > 0.5))  # never stricter than the regression is
    chosen = keys[places]
    order = np.argsort(chosen)
    return Model(chosen[order], w[order], bias, [(int(p), float(q), float(r), int(t)) for p, q, r, t in zip(chosen, a, b, parent, strict=True)])


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, total: int = SAMPLE) -> Model:
    """Fit on labelled rows whose fold is not 0: about ``each`` of a class at most, ``total`` in all.

    A document labelled more than once takes the larger label; null labels, null ids and labels without a document are left out. Words are counted in executors;
    the driver gets those that vote, and which of them fire on each row of the sample.
    """
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.filter("doc_id is not null and toxic is not null").filter(fold() != 0).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = by_hash(named, "toxic", each, total)  # of a bounded size: at most `total` ids

    def read(batches):
        for batch in slices(batches):
            found, of = patterns(texts(batch))
            pair = np.unique(of << BITS | found)
            ends = np.searchsorted(pair >> BITS, np.arange(batch.num_rows + 1))
            low = (pair & (1 << BITS) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([low[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "toxic", "found"])

    def count(batches):
        for batch in slices(batches, "found"):
            rows = [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
            key, place = np.unique(np.concatenate(rows), return_inverse=True)
            y = np.repeat(np.asarray(batch.column(1)), [len(r) for r in rows])
            toxic = np.bincount(place.reshape(-1), y, len(key)).astype(np.int64)
            n = np.bincount(place.reshape(-1), minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(toxic), pa.array(n - toxic)], ["key", "toxic", "clean"])

    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    sample = cut(seen.mapInArrow(read, "doc_id bigint, toxic int, found binary"), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:  # one class only: nothing to tell apart
        forget(sample)
        return _constant((n1 + 1) / (n1 + n0 + 2))
    counts = sample.mapInArrow(count, "key bigint, toxic bigint, clean bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate1, rate0 = (F.col("toxic") + 0.1) / (n1 + 0.2), (F.col("clean") + 0.1) / (n0 + 0.2)
    telling = ((F.col("toxic") >= LEAST) & (rate1 > PURITY * rate0)) | ((F.col("clean") >= LEAST) & (rate0 > PURITY * rate1))
    g = _evidence(F.col("toxic"), F.col("clean"), n1, n0)
    voters = counts.filter((F.col("key") < len(FIXED)) | (telling & (g >= EVIDENCE))).select("key", F.when(F.col("key") < len(FIXED), F.lit(1e9) - F.col("key")).otherwise(g).alias("g"))
    keys = np.array([r["key"] for r in voters.orderBy(F.desc("g"), "key").select("key").collect()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(keys))  # words that vote: each with EVIDENCE in a sample of a bounded size

    def vote(batches):
        known = shared.value
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                at = np.searchsorted(known, found := np.frombuffer(x, np.uint32).astype(np.int64))
                at[at == len(known)] = 0
                out.append(at[known[at] == found].astype(np.int32).tobytes() if len(known) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "toxic", "fires"])

    rows = sample.mapInArrow(vote, "doc_id bigint, toxic int, fires binary").collect()
    forget(sample)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["fires"])))
    back = np.argsort(keys)  # place among the sorted keys -> place in order of evidence
    return fit_votes(keys, [back[np.frombuffer(r["fires"], np.int32)] for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: the probability of the toxic class of each whole text, null as empty."""
    names = docs.columns
    carry = [f"c{i}" for i in range(len(names))]
    text = carry[names.index(text_col)]
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))  # the voters

    def run(batches):
        own = Model(*shared.value, [])
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.scores(texts(batch, text)))], [*carry, "score"])

    plain = docs.toDF(*carry)
    return plain.mapInArrow(run, schema(plain, carry, "score double")).toDF(*names, name)


def toxicity(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted.

    Texts are scored whole; labels, lang, source and doc_id are no inputs of a score. Null and empty texts get the
    score of no evidence; rows that repeat are scored one by one; without labels of both classes every
    score is the smoothed rate of class 1. A null doc_id is scored, and held_out is null.
    """
    model = fit(docs, labels, **fit_options)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """The documents, all columns, whose score is below 0.5."""
    model = fit(docs, labels, **fit_options)
    scored = score(docs, model, name="_toxicity of the whole text")
    return scored.filter(F.col("`_toxicity of the whole text`") < 0.5).drop("_toxicity of the whole text")
