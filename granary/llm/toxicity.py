"""Toxic spans and document scores from a linear-chain conditional random field.

Two tags (O, T). A token's features are its lower-cased word and the word's prefixes. Labels are of documents, so the
labelled tokens are derived: one document of each group of near copies is kept, and features are taken one by one by a
likelihood ratio test against the toxic label, by words that no feature taken before explains, over the toxic documents that have
fewer than ``COVER`` words explained (else whatever stands beside a toxic word would count as toxic). The test's level follows from how
many features there are to try, so that few labels suffice for few features. Tokens of toxic documents with a taken feature
are tagged T, and the field is fitted by gradient ascent on the conditional likelihood (forward-backward), with decaying
weights. Tokens without a used feature all look alike, so a run of them is one power of the transition matrix: scoring takes
forward-backward over the other tokens only and is exact. A document's score is a logistic of the odds that any token is
toxic, of how many are, both from the marginals, and of its length, since what looks toxic by chance grows with it; its spans
are the runs of tokens whose marginal is at least one half.

Cases: null and empty texts have no tokens, no spans and the score of a text without evidence; labels of null or of
documents that are not there are ignored; without labels of both kinds every score is 0, or without features the share of toxic
labels. Repeated rows are scored alike; of rows that share a labelled id the least text is learnt. Ties between features go to
the whole word, then to the longer prefix, then to the least hash. Very long texts are scored whole, one at a time. Only the fit
has texts on the driver: those of at most ``max_toxic`` and ``max_clean`` labelled documents, whole, until the field is fitted.
Other columns are not read by ``tag`` and pass through ``scored``, where only a column of the score's name is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)
#: What a feature's likelihood ratio statistic must be over twice the log of the number of features tried.
MARGIN = 4.0
#: Most labelled documents of either kind that the field is fitted to.
MAX_TOXIC, MAX_CLEAN = 2000, 4000
SEGMENT = 32
#: Segments whose gradient is taken at once; bounds the driver's memory.
PART = 2048
COVER = 12


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class Field:
    """Weights: ``words`` of features, ``bias`` of tag T, ``moves[a][b]`` of tag a before b, ``judge`` of a document's measures."""

    words: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    judge: tuple[float, ...] = (0.0, 10.0, 0.0, 0.0)

    @cached_property
    def starts(self) -> frozenset[str]:
        """The first letters of all words that can have a used feature."""
        return frozenset(f.removeprefix("=")[: min(PREFIXES)] for f in self.words)

    def emission(self, word: str) -> float | None:
        """Log weight of tag T against O; None if the token has no used feature."""
        used = [self.words[f] for f in features(word) if f in self.words]
        return sum(used) + self.bias if used else None

    def run(self, n: int) -> np.ndarray:
        """Weight matrix of n default tokens and the move into each, scaled."""
        m = np.exp(self.moves) * np.exp([0.0, self.bias])
        return _power(m / m.sum(), n)


def _power(m: np.ndarray, n: int) -> np.ndarray:
    out = np.eye(2)
    while n:
        if n & 1:
            out = out @ m
            out /= out.sum()
        m = m @ m
        m /= m.sum()
        n >>= 1
    return out


def marginals(model: Field, places: list[int], weights: list[float], n: int) -> list[float]:
    """P(tag T) at ``places`` of a chain of n tokens, all others default; forward-backward with scaling."""
    if not places:
        return []
    move = np.exp(model.moves)
    forward, state, at = [], np.array([1.0, 0.0]), -1  # a virtual O stands before the text
    emit = [np.array([1.0, math.exp(min(w, 50.0))]) for w in weights]
    gaps = []
    for p, e in zip(places, emit, strict=True):
        gaps.append(model.run(p - at - 1) if p - at > 1 else None)
        if gaps[-1] is not None:
            state = state @ gaps[-1]
        state = (state @ move) * e
        state /= state.sum()
        forward.append(state)
        at = p
    back = model.run(n - 1 - at) @ np.ones(2) if n - 1 > at else np.ones(2)
    out = [0.0] * len(places)
    for k in range(len(places) - 1, -1, -1):
        both = forward[k] * back
        out[k] = float(both[1] / both.sum())
        back = move @ (emit[k] * back)
        if gaps[k] is not None:
            back = gaps[k] @ back
        back /= back.sum()
    return out


def evidence(probabilities: list[float]) -> float:
    """Log odds that any of the tokens is toxic, within +-14."""
    none = sum(math.log1p(-min(p, 1 - 1e-9)) for p in probabilities)
    odds = -math.expm1(none)
    return -14.0 if odds <= 1e-6 else min(14.0, math.log(odds) - none)


def _ratios(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G statistics of features in a of n1 toxic and b of n0 clean documents; 0 for those that lean to clean ones."""
    total, g = n1 + n0, np.zeros(len(a))
    for seen, row, col in ((a, a + b, n1), (b, a + b, n0), (n1 - a, total - a - b, n1), (n0 - b, total - a - b, n0)):
        some = seen > 0
        g[some] += 2 * seen[some] * np.log(seen[some] * total / (row[some] * col))
    return np.where(a * n0 <= b * n1, 0.0, g)


@dataclass
class _Samples:
    """Tokenized samples: ``docs`` are word numbers in order, ``sets`` the distinct ones; ``features[w]`` are numbers of a word's features, -1 for none."""

    words: list[str]
    docs: list[np.ndarray]
    sets: list[np.ndarray]
    features: np.ndarray


def _tokenized(texts: list[str | None]) -> _Samples:
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in map(str.lower, WORD.findall(t or ""))], np.int32) for t in texts]
    words = list(known)
    # features are told apart by 64-bit hashes: their strings would take more memory than the texts
    hashed = np.zeros((len(words), 1 + len(PREFIXES)), np.uint64)
    for i, w in enumerate(words):
        for k, f in enumerate(features(w)):
            hashed[i, k] = xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass"))
    found, numbers = np.unique(hashed, return_inverse=True)
    numbers = numbers.reshape(hashed.shape).astype(np.int32) - bool(len(found) and found[0] == 0)
    return _Samples(words, docs, [np.unique(d) for d in docs], numbers)


def _singled(samples: _Samples) -> list[int]:
    """Indices of the samples without near copies of earlier ones: five bands of three minima of word hashes."""
    seeds = np.random.Generator(np.random.PCG64(11)).integers(1, 2**31, (15, 2), dtype=np.uint64) | np.uint64(1)
    crc = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in samples.words], np.uint64)
    known: set[tuple] = set()
    out = []
    for i, words in enumerate(samples.sets):
        h = crc[words] if len(words) else np.zeros(1, np.uint64)
        least = ((h[:, None] * seeds[:, 0] + seeds[:, 1]) & np.uint64(0xFFFFFFFF)).min(0).tolist()
        bands = {(k, *least[3 * k : 3 * k + 3]) for k in range(5)}
        if not bands & known:
            out.append(i)
        known |= bands
    return out


def _taken(samples: _Samples, labels: list[int]) -> list[str]:
    """The features tied to the toxic label, in the order in which they are taken."""
    kept = _singled(samples)
    toxic, clean = [samples.sets[i] for i in kept if labels[i]], [samples.sets[i] for i in kept if not labels[i]]
    n1, n0 = len(toxic), len(clean)
    size = int(samples.features.max(initial=-1)) + 1
    if not n1 or not n0 or not size:
        return []

    def present(words: np.ndarray) -> np.ndarray:
        found = np.unique(samples.features[words])
        return found[found >= 0]

    seen, free = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for words in toxic:
        seen[present(words)] += 1
    for words in clean:
        free[present(words)] += 1
    often = np.flatnonzero(seen >= 3)
    if not len(often):
        return []
    # as many features as may be tried are expected to reach this by chance a few hundredths of once
    least = 2 * math.log(len(often)) + MARGIN
    open_ = often[_ratios(seen[often].astype(float), free[often].astype(float), n1, n0) >= least]
    place = np.full(size, -1)
    place[open_] = np.arange(len(open_))
    of = [place[samples.features[words]] for words in toxic]  # the numbers of the open features of each word of a document
    left = np.zeros((n1, len(open_)), np.int16)  # words of a document that a feature would explain
    for d, words in enumerate(of):
        np.add.at(left[d], words[words >= 0], 1)
    # of features in the same documents the whole word goes first, then the longer prefix
    narrow = np.zeros(size)
    for k in range(samples.features.shape[1]):
        narrow[samples.features[:, k][samples.features[:, k] >= 0]] = 2.0 if k == 0 else k / 10
    narrow = narrow[open_] * 1e-6
    cover, done, out = np.zeros(n1, int), [np.zeros(len(w), bool) for w in toxic], []
    live = np.ones(len(open_), bool)
    while live.any():
        active = cover < COVER
        if not active.any():
            break
        scores = _ratios((left[active] > 0).sum(0).astype(float), free[open_].astype(float), int(active.sum()), n0)
        live &= scores >= least
        if not live.any():
            break
        best = int(np.argmax(np.where(live, np.round(scores, 5) + narrow, -1.0)))  # then ties go to the least hash
        live[best] = False
        for d in np.flatnonzero(left[:, best]).tolist():
            new = (of[d] == best).any(1) & ~done[d]
            explained = of[d][new]
            np.subtract.at(left[d], explained[explained >= 0], 1)
            cover[d] += int(new.sum())
            done[d] |= new
        w = toxic[d][new][0]
        out.append(features(samples.words[w])[int(np.flatnonzero(samples.features[w] == open_[best])[0])])
    return out


class _Part:
    """Some tagged segments, padded to one length, and the gradient of their conditional likelihood."""

    def __init__(self, segments: list[list[list[int]]], tags: list[list[int]]):
        n, size = len(segments), max(map(len, segments))
        self.y = np.full((n, size), -1)
        for k, t in enumerate(tags):
            self.y[k, : len(t)] = t
        self.row = np.array([k * size + i for k, s in enumerate(segments) for i, fs in enumerate(s) for _ in fs], int)
        self.col = np.array([f for s in segments for fs in s for f in fs], int)
        self.before = np.concatenate((np.zeros((n, 1), int), np.maximum(self.y[:, :-1], 0)), axis=1)

    def gradient(self, theta: np.ndarray, used: int) -> np.ndarray:
        """By forward-backward: tags told less tags expected, and the same for pairs of neighbours."""
        y, (n, size) = self.y, self.y.shape
        real = y >= 0
        w, bias, moves = theta[:used], theta[-5], theta[-4:].reshape(2, 2)
        emit = np.zeros((n, size, 2))
        emit[..., 1] = bias + np.bincount(self.row, w[self.col], n * size).reshape(n, size)
        emit = np.exp(np.clip(emit, -40, 40)) * real[..., None] + (~real)[..., None] * np.array([1.0, 0.0])
        move = np.exp(moves)
        alpha, beta = np.empty((n, size, 2)), np.ones((n, size, 2))
        state = np.tile([1.0, 0.0], (n, 1))
        for t in range(size):
            state = (state @ move) * emit[:, t]
            state /= state.sum(1, keepdims=True)
            alpha[:, t] = state
        for t in range(size - 2, -1, -1):
            back = (emit[:, t + 1] * beta[:, t + 1]) @ move.T
            beta[:, t] = back / back.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        prior = np.concatenate((np.tile([[[1.0, 0.0]]], (n, 1, 1)), alpha[:, :-1]), axis=1)
        pair = prior[..., :, None] * move * (emit * beta)[..., None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        gap = (y == 1) - p[..., 1]
        told = np.zeros((n, size, 2, 2))
        told[np.arange(n)[:, None], np.arange(size), self.before, np.maximum(y, 0)] = 1
        moved = ((told - pair) * real[..., None, None]).sum((0, 1)).ravel()
        return np.concatenate((np.bincount(self.col, gap.ravel()[self.row], used), [(gap * real).sum()], moved))


def fit(samples: list[tuple[str, int]], rounds: int = 60) -> Field:
    """Fit the field to (text, label 0 or 1) pairs; deterministic for a given order."""
    labels = [y for _, y in samples]
    n1 = sum(labels)
    n0 = len(samples) - n1
    if not n1 or not n0:
        return Field(judge=(-50.0, 0.0, 0.0, 0.0))
    bag = _tokenized([t for t, _ in samples])
    used = _taken(bag, labels)
    if not used:
        return Field(judge=(math.log(n1 / n0) if n1 < n0 else 0.0, 0.0, 0.0, 0.0))
    index = {f: k for k, f in enumerate(used)}
    of = [[index[f] for f in features(w) if f in index] for w in bag.words]
    some = np.array([bool(f) for f in of])
    segments, tags = [], []
    for words, y in zip(bag.docs, labels, strict=True):
        cuts = range(0, len(words), SEGMENT)
        for s in [s for s in cuts if some[words[s : s + SEGMENT]].any()] or list(cuts)[:1]:
            part = words[s : s + SEGMENT].tolist()
            segments.append([of[w] for w in part])
            tags.append([int(bool(y and of[w])) for w in part])
    if not segments:
        return Field(judge=(math.log(n1 / n0) if n1 < n0 else 0.0, 0.0, 0.0, 0.0))
    theta = np.concatenate((np.full(len(used), 3.0), [-6.0, 0.0, 0.0, 0.0, 0.0]))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    parts = [_Part(segments[k : k + PART], tags[k : k + PART]) for k in range(0, len(segments), PART)]
    decay = np.concatenate((np.full(len(used), 0.05), [0.01], np.full(4, 0.05)))
    for step in range(1, rounds + 1):
        grad = sum(part.gradient(theta, len(used)) for part in parts) - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model = Field(dict(zip(used, theta[: len(used)].tolist(), strict=True)), float(theta[-5]), theta[-4:].reshape(2, 2).copy())
    weight = np.array([sum(model.words[used[k]] for k in f) + model.bias if f else np.nan for f in of])
    x = np.empty((len(bag.docs), 4))
    for i, words in enumerate(bag.docs):
        e = weight[words] if len(words) else np.zeros(0)
        places = np.flatnonzero(~np.isnan(e))
        x[i] = measures(marginals(model, places.tolist(), e[places].tolist(), len(words)), len(words))
    model.judge = _logistic(x, np.array(labels))
    return model


def measures(probabilities: list[float], n: int) -> tuple[float, float, float, float]:
    """What a document is judged by: 1, the odds that any token is toxic, how many tokens are, and how long it is (what occurs by chance grows with it)."""
    return 1.0, evidence(probabilities) / 10, math.log1p(sum(probabilities)), math.log1p(n) / 4


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Weights of P(y = 1 | x), a little ridge, by Newton's method on smoothed targets; the first column is constant."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    w[0] = math.log((n1 + 1) / (n0 + 1))
    ridge = np.array([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        v = p * (1 - p) + 1e-9
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w = w + min(1.0, 2.0 / (np.abs(step).max() + 1e-12)) * step
    return tuple(w.tolist())


def _doc_marginals(model: Field, words: list[str]) -> tuple[list[int], list[float]]:
    starts, size = model.starts, min(PREFIXES)
    places, weights = [], []
    for i, w in enumerate(map(str.lower, words)):
        if w[:size] in starts and (e := model.emission(w)) is not None:
            places.append(i)
            weights.append(e)
    return places, marginals(model, places, weights, len(words))


def score_text(model: Field, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """(score, spans): spans are (start, stop, largest marginal) in characters of the text."""
    words = WORD.findall(text or "")
    places, p = _doc_marginals(model, words)
    z = sum(a * b for a, b in zip(model.judge, measures(p, len(words)), strict=True))
    score = 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))
    hot = {i: q for i, q in zip(places, p, strict=True) if q >= 0.5}
    spans: list[tuple[int, int, float]] = []
    if hot:
        last = -2
        for i, m in enumerate(WORD.finditer(text)):
            if i in hot:
                if i == last + 1:
                    spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], hot[i]))
                else:
                    spans.append((m.start(), m.end(), hot[i]))
                last = i
    return score, spans


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Field:
    """Fit to labelled documents, ``max_toxic`` and ``max_clean`` at most, chosen by a hash of the id."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("y"))
    told = told.withColumn("order", F.xxhash64("id"))
    chosen = told.where("y = 1").orderBy("order", "id").limit(max_toxic).unionByName(told.where("y = 0").orderBy("order", "id").limit(max_clean))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"), F.min("order").alias("order")).collect()
    return fit([(r["text"] or "", int(r["y"])) for r in sorted(rows, key=lambda r: (r["order"], r["id"]))])


def tag(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans array<struct<start, stop, p>>) of every row."""

    def run(batches):
        for b in batches:
            found = [score_text(model, t.as_py()) for t in b.column(1)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))
            spans = [[{"start": s, "stop": e, "p": p} for s, e, p in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array(spans, kind)], ["id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, spans array<struct<start:int,stop:int,p:double>>")


def scored(docs: DataFrame, model: Field, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each text as a further column ``name``."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array([score_text(model, x.as_py())[0] for x in t], pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
