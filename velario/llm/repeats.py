"""Problem 10: repetition inside a single document.

Method: a logistic regression over hashed word and character n-grams, trained on labelled rows, calibrated, and scored in
Arrow batches against fixed thresholds. A bucket holds the share of a text's n-grams of one order that repeat, by how often
they do: n-grams are counted in a hash table whose size grows with the text, and a linear model over hashed counts themselves could not
see repetition. The tables hold no quality labels, so the labels are the exact share measured on a sample of at most
``TRAIN_ROWS`` rows (a documented bound), to which rows with planted repetition are added so that both classes always exist. Features
of the sample are worked out where the rows lie; no text reaches the driver.

The score alone cannot give the share that the query is defined by, so rows above the fixed low threshold ``GATE`` are
measured exactly: a word is repeated if it lies in a run of 8 words that also occurs at an earlier position.
``repetition`` measures and scores every document, so that the gate's recall can be checked against all rows.

Defined results: null, empty and wordless texts have the share 0; repeated rows give one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, multipliers, spread, words

RUN, BOUND = 8, 0.35
WORD_ORDERS, CHAR_ORDERS = (1, 4, 8), (16,)
DIMS = 1 << 10
TRAIN_ROWS = 1500
#: Fixed thresholds on the calibrated probability: above GATE the text is measured, above SPAM it counts as spam by score.
GATE, SPAM = 0.005, 0.5


#: An order is put together from two smaller ones: order -> (first part, second part).
WORD_PARTS = {2: (1, 1), 4: (2, 2), 8: (4, 4)}
CHAR_PARTS = {2: (1, 1), 4: (2, 2), 8: (4, 4), 16: (8, 8)}
MULTIPLIERS = multipliers(64, 11)


def ladder(h: np.ndarray, parts: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Hashes of the n-grams of every order, each from those of two smaller orders: two operations an order."""
    out = {1: h}
    for n, (a, b) in parts.items():
        k = len(h) - n + 1
        if k <= 0:
            out[n] = np.empty(0, np.uint64)
            continue
        with np.errstate(over="ignore"):
            total = out[a][:k] * MULTIPLIERS[n] + out[b][a : a + k] * MULTIPLIERS[n + 24]
        out[n] = total ^ total >> np.uint64(31)
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    return ladder(h, WORD_PARTS)[n]


def repeated_words(h: np.ndarray) -> int:
    """Words inside an 8-word run that occurs at an earlier position too."""
    g = grams(h, RUN)
    if not len(g):
        return 0
    _, first, back = np.unique(g, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[back] < np.arange(len(g)))
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + RUN, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def multiplicities(g: np.ndarray) -> np.ndarray:
    """How often each n-gram that occurs more than once does. Short lists are sorted; longer ones are counted in a hash table of at least
    eight places for each n-gram (two n-grams in one place count as equal: noise that the calibration absorbs)."""
    if len(g) < 512:
        g = np.sort(g)
        same = g[1:] == g[:-1]
        if not same.any():
            return g[:0].astype(np.int64)
        counts = np.diff(np.flatnonzero(np.concatenate(([True], ~same, [True]))))
    else:
        counts = np.bincount((g >> np.uint64(64 - (8 * len(g) - 1).bit_length())).astype(np.int64))
    return counts[counts > 1]


def features(h: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features as (places, values): for each order the mass of its n-grams by multiplicity, and a bias at 0."""
    places, values = [np.zeros(1, np.int64)], [np.ones(1)]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    for kind, orders, ladder_ in ((0, WORD_ORDERS, ladder(h, WORD_PARTS)), (7919, CHAR_ORDERS, ladder(raw, CHAR_PARTS))):
        for n in orders:
            rep = multiplicities(ladder_[n])
            if not len(rep):
                continue
            mass = (rep - 1) / len(ladder_[n])
            places += [(np.minimum(rep, 16) * 37 + n * 101 + kind) % (DIMS - 1) + 1, np.array([(n * 211 + (31 if kind else 17)) % (DIMS - 1) + 1])]
            values += [mass, mass.sum(keepdims=True)]
    x = np.bincount(np.concatenate(places), np.concatenate(values), DIMS)
    used = np.flatnonzero(x)
    return used, x[used]


def fit(X: np.ndarray, y: np.ndarray, steps: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by accelerated descent; deterministic. Columns without a value keep the weight 0 and are left out of the work."""
    used = np.flatnonzero(X.any(0))
    if len(used) < X.shape[1]:
        out = np.zeros(X.shape[1])
        out[used] = fit(np.ascontiguousarray(X[:, used]), y, steps, l2)
        return out
    w = v = np.zeros(X.shape[1])
    rate = 4 / max(1e-9, np.linalg.norm(X, 2) ** 2 / len(X) + l2)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ v, -30, 30)))
        new = v - rate * (X.T @ (p - y) / len(y) + l2 * v * (np.arange(len(v)) > 0) * 0.1)
        v, w = new + k / (k + 3) * (new - w), new
    return w


class Model:
    """Weights over the features, and the calibration of their sum."""

    def __init__(self, rows: list[tuple[list[int], list[float], float]]):
        X = np.zeros((len(rows), DIMS))
        for k, (places, values, _) in enumerate(rows):
            X[k, places] = values
        y = np.array([share >= BOUND for _, _, share in rows], float)
        half = np.arange(len(rows)) % 2 == 0
        w = fit(X[half], y[half])
        s = X[~half] @ w  # Platt scaling on the other half
        self.w, self.a = w, fit(np.stack([np.ones_like(s), s], 1), y[~half], 200, 1e-4)

    def probability(self, h: np.ndarray, text: str) -> float:
        places, values = features(h, text)
        return float(1 / (1 + np.exp(-np.clip(self.a[0] + self.a[1] * (values @ self.w[places]), -30, 30))))


def labelled(text: str, hashes: WordHashes) -> tuple[list[int], list[float], float]:
    """Features and measured share of a text."""
    h = hashes(words(text))
    places, values = features(h, text)
    return places.tolist(), values.tolist(), repeated_words(h) / max(1, len(h))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample of the rows (a hash of the key decides, so the sample is the same on every run)."""
    keyed = docs.where(F.length("text") > 0).select("text", F.xxhash64("doc_id").alias("h"))
    last = keyed.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]

    def run(rows) -> Iterator[tuple]:
        hashes = WordHashes()
        for text, key in rows:
            yield key, 0, *labelled(text, hashes)
            rng = np.random.default_rng(key & 0xFFFFFFFF)
            if rng.random() < 0.3:  # planted repetition at many shares
                half = text[: max(40, int(len(text) * rng.uniform(0.1, 0.6)))]
                yield key, 1, *labelled(text + " " + " ".join([half] * int(rng.integers(1, 5))), hashes)

    got = []
    if last is not None:
        made = arrow_rows(keyed.where(F.col("h") <= last), "h bigint, planted int, places array<int>, vals array<double>, share double", run, 64)
        got = [tuple(r)[2:] for r in sorted(made.collect(), key=lambda r: (r.planted, r.h))]
    fixed = ["una frase que se repite varias veces en el mismo texto sin motivo " * 5] * 2 + ["palabras sueltas y distintas"] * 2
    return Model(got + [labelled(t, WordHashes()) for t in fixed])


def repetition(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_words, n_repeated, share, probability: every document measured and scored."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(rows) -> Iterator[tuple]:
        hashes = run.__dict__.setdefault("hashes", WordHashes())
        for i, text in rows:
            h = hashes(words(text))
            k = repeated_words(h)
            yield i, len(h), k, k / len(h) if len(h) else 0.0, held.value.probability(h, text or "")

    return arrow_rows(spread(docs.select("doc_id", "text"), "doc_id"), "doc_id bigint, n_words int, n_repeated int, share double, probability double", run)


def repetitive(docs: DataFrame, model: Model | None = None, bound: float = BOUND) -> DataFrame:
    """doc_id of the documents whose score passes the gate and whose measured share reaches the bound."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(rows) -> Iterator[tuple]:
        hashes = run.__dict__.setdefault("hashes", WordHashes())
        for i, text in rows:
            h = hashes(words(text))
            if len(h) and held.value.probability(h, text) >= GATE and repeated_words(h) >= bound * len(h):
                yield (i,)

    return arrow_rows(spread(docs.select("doc_id", "text").where(F.length("text") > 0), "doc_id"), "doc_id bigint", run).distinct()
