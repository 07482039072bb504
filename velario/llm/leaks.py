"""Problem 9: passages of held-out items inside corpus documents, by spaced-seed hashing.

Fixed masks over a window of ``RUN`` words ignore some positions; the masked hashes of all windows of the items are joined
with those of all windows of the documents, so that a window with substituted words at ignored positions still meets its
item. Around each hit the words themselves are compared (an exact check), which gives the exact run and the overlap that
tolerates substitutions.

Two ways, chosen by a checked size, with the same rows: while the items' windows number at most ``most_windows`` their sorted
hashes are broadcast (documents stay where they are: no shuffle); beyond that, hashes of both sides are joined in a shuffle, where
item hashes occurring more often than a bound (the most frequent of them, a bounded number) are salted by position; only the
pairs that share a hash then meet their texts, and are verified by the same comparison.

Defined results: null and empty texts and items have no windows and give no rows; repeated rows give one row; texts with
fewer than ``RUN`` words never match, however few characters hold those words; other columns are ignored. ``alike_words`` counts the
equal words of the best tolerant stretch, not of chance hits elsewhere on its diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, multipliers, spread, words

RUN = 12
#: Spaced seeds of 12 positions; together they look at every position.
MASKS = ("110110101101", "101011110110", "011101011011")
#: A tolerant overlap must be at least so long and so alike.
TOLERANT_WORDS, TOLERANT_SHARE = 12, 0.75
#: In a shuffle, item hashes occurring more often than HOT are spread over SALTS tasks; at most MOST_HOT of them are broadcast.
HOT, SALTS, MOST_HOT = 100, 32, 10_000


def masked(h: np.ndarray) -> list[np.ndarray]:
    """For each mask the hashes of all windows of a sequence of word hashes."""
    n, m = len(h) - RUN + 1, multipliers(RUN)
    if n <= 0:
        return [np.empty(0, np.uint64)] * len(MASKS)
    out = []
    with np.errstate(over="ignore"):
        for k, mask in enumerate(MASKS):
            total = np.full(n, np.uint64(k + 1))
            for j, bit in enumerate(mask):
                if bit == "1":
                    total += h[j : j + n] * m[j]
            out.append(total ^ total >> np.uint64(29))
    return out


class Index:
    """Sorted masked hashes of the items, with item and position, and the items' word hashes to verify with."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashes(words(t)) for _, t in items]
        parts = [[], [], []]
        for k, h in enumerate(self.words):
            for hs in masked(h):
                parts[0].append(hs)
                parts[1].append(np.full(len(hs), k))
                parts[2].append(np.arange(len(hs)))
        key, item, at = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], item[order], at[order]

    def matches(self, h: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """item -> longest exact run, best tolerant overlap (equal words), and its place in the document."""
        best: dict[int, tuple[int, int, int]] = {}
        if len(h) < RUN or not len(self.key):
            return best
        diagonals = set()
        for hs in masked(h):
            lo, hi = np.searchsorted(self.key, hs, "left"), np.searchsorted(self.key, hs, "right")
            for p in np.flatnonzero(hi > lo):
                for q in range(lo[p], hi[p]):
                    diagonals.add((int(self.item[q]), int(p) - int(self.at[q])))
        for k, d in sorted(diagonals):
            best[k] = better(best.get(k, NOTHING), overlap(h, self.words[k], d))
        return best


#: Longest exact run, equal words of the best tolerant stretch, first word of the run or, without one, of the stretch.
NOTHING = (0, 0, 0)


def better(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """Of two diagonals of a pair: the longer run with its place (the earlier of equal ones), and the larger tolerant count."""
    run = max((a, b), key=lambda x: (x[0] if x[0] >= RUN else 0, x[1], -x[2]))
    return (max(a[0], b[0]), max(a[1], b[1]), run[2])


def overlap(h: np.ndarray, item: np.ndarray, d: int) -> tuple[int, int, int]:
    """What document and item share where word i of the item lies on word i + d of the document."""
    a, b = max(0, d), min(len(h), len(item) + d)
    same = h[a:b] == item[a - d : b - d]
    edges = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
    runs = edges[1::2] - edges[::2]
    i = int(np.argmax(runs)) if len(runs) else 0
    exact, start = (int(runs[i]), int(edges[2 * i]) + a) if len(runs) else (0, a)
    if b - a < TOLERANT_WORDS:
        return exact, 0, start
    total = np.r_[0, np.cumsum(same)]
    near = np.flatnonzero(total[TOLERANT_WORDS:] - total[:-TOLERANT_WORDS] >= TOLERANT_WORDS * TOLERANT_SHARE)
    if not len(near):
        return exact, 0, start
    cuts = np.flatnonzero(np.diff(near) > 1)  # stretches of windows without a gap
    first, last = near[np.r_[0, cuts + 1]], near[np.r_[cuts, len(near) - 1]] + TOLERANT_WORDS
    equal = total[last] - total[first]
    k = int(np.argmax(equal))
    return exact, int(equal[k]), start if exact >= RUN else int(first[k]) + a


def leaks(docs: DataFrame, items: DataFrame, most_windows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, run_words (longest exact run), alike_words (substitution-tolerant), first_word."""
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).dropDuplicates(["item_id"])
    size = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0  # at most one word for two characters
    if size * len(MASKS) <= most_windows:
        return _broadcast(docs, items)
    return _shuffled(docs, items)


SCHEMA = "doc_id bigint, item_id bigint, run_words int, alike_words int, first_word int"


def _broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))

    def run(rows) -> Iterator[tuple]:
        ix, hashes = index.value, run.__dict__.setdefault("hashes", WordHashes())
        for doc_id, text in rows:
            if text:
                for k, (exact, alike, start) in ix.matches(hashes(words(text))).items():
                    if exact >= RUN or alike:
                        yield doc_id, ix.ids[k], exact, alike, start

    return arrow_rows(spread(docs.select("doc_id", "text").where(F.length("text") > 0), "doc_id"), SCHEMA, run).dropDuplicates(["doc_id", "item_id"])


def _windows(df: DataFrame, key: str) -> DataFrame:
    def run(rows) -> Iterator[tuple]:
        hashes = WordHashes()
        for i, text in rows:
            for k, hs in enumerate(masked(hashes(words(text)))):
                for at, x in enumerate(hs.view(np.int64).tolist()):
                    yield x, k, i, at

    return arrow_rows(df.select(key, "text").where(F.length("text") > 0), f"h bigint, mask int, {key} bigint, at int", run, 64)


def salted(left: DataFrame, right: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: windows of documents under a hot item hash get one by document and position, the items' all of them."""
    often = right.groupBy("h", "mask").agg(F.count("*").alias("n")).where(F.col("n") > hot).orderBy(F.desc("n"), "h", "mask").limit(MOST_HOT)
    often = F.broadcast(often.select("h", "mask", F.lit(True).alias("hot")))
    one = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(often, ["h", "mask"], "left").withColumn("salt", one).drop("hot")
    return left, right.join(often, ["h", "mask"], "left").withColumn("salt", F.explode(every)).drop("hot")


def _shuffled(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Two-sided join on masked hashes; the diagonals of a pair that shares one meet both texts and are compared word by word."""
    docs = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    right = _windows(items, "item_id").withColumnRenamed("at", "item_at")
    left, right = salted(_windows(docs, "doc_id"), right)
    hits = left.join(right, ["h", "mask", "salt"]).groupBy("doc_id", "item_id").agg(F.collect_set((F.col("at") - F.col("item_at")).cast("int")).alias("diagonals"))
    # an item may hit very many documents: its text is kept once for each salt, the pairs choose one by document
    spread_items = items.select("item_id", F.col("text").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread_items, ["item_id", "salt"]).join(docs, "doc_id")

    def run(rows) -> Iterator[tuple]:
        hashes = run.__dict__.setdefault("hashes", WordHashes())
        for doc_id, item_id, diagonals, item, text in rows:
            best, h, w = NOTHING, hashes(words(text)), hashes(words(item))
            for d in sorted(diagonals):
                best = better(best, overlap(h, w, d))
            if best[0] >= RUN or best[1]:
                yield doc_id, item_id, *best

    return arrow_rows(pairs.select("doc_id", "item_id", "diagonals", "item", "text"), SCHEMA, run)
