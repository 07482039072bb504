"""Problem 7: cutting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over a window of code points marks landmarks, places that depend on the nearby content alone. Between the
minimum and the maximum size the strongest landmark is taken and snapped to the nearest natural boundary of the best kind in that range
(empty line, sentence end, line, clause, blank: a better kind counts for more than nearness), so that an edit moves only the cuts next to it. Every piece after the first begins exactly
``overlap_tokens`` before the end of the piece before it.

Defined results: null text or null limit gives no piece; an empty text gives none; a text within its limit is one piece; an
overlap of at least half the limit is reduced to half (else no progress would be possible); runs without any boundary are cut at the
limit. Offsets count code points of the row's own text. Repeated rows give the same pieces once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, multipliers, spread

#: Code points of a token and of the rolling window.
PER_TOKEN, WINDOW = 4, 24
#: Kinds of natural boundaries, best first: (weight, pattern whose end is a place to cut).
BOUNDARIES = (
    (1.0, re.compile(r"\n[ \t\r]*\n\s*")),
    (0.9, re.compile(r"[.!?…]+[\"'”»’)\]]*\s+|[。！？]+[」』”’）]*\s*|[।؟۔]+\s*")),
    (0.7, re.compile(r"\n\s*")),
    (0.55, re.compile(r"[;:；：]\s*")),
    (0.4, re.compile(r"[,、，،]\s*")),
    (0.25, re.compile(r"\s+")),
)


def tokens(n: int) -> int:
    return (n + PER_TOKEN - 1) // PER_TOKEN


def strength(text: str) -> np.ndarray:
    """Rolling hash of the window before each place, scaled to 0..1."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    padded = np.r_[np.zeros(WINDOW, np.uint64), code]
    total = np.zeros(len(code) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, m in enumerate(multipliers(WINDOW, 3)):
            total += padded[j : j + len(code) + 1] * m
    return (total >> np.uint64(40)).astype(np.float64) / (1 << 24)


def natural(text: str) -> np.ndarray:
    """Weight of each place as a natural boundary; 0 where there is none."""
    weight = np.zeros(len(text) + 1)
    for w, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            weight[m.end()] = max(weight[m.end()], w)
    return weight


def cut(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int]]:
    """Pieces as (start, end); each holds at most ``max_tokens``, and overlaps the one before by ``overlap_tokens``."""
    n, most = len(text), max(1, max_tokens) * PER_TOKEN
    if n <= most:
        return [(0, n)] if n else []
    back = min(max(0, overlap_tokens) * PER_TOKEN, most // 2)
    least = max(back + 1, most // 2)
    hashed, weight = strength(text), natural(text)
    out, start = [], 0
    while n - start > most:
        lo, hi = start + least, start + most
        landmark = lo + int(np.argmax(hashed[lo : hi + 1]))
        places = np.flatnonzero(weight[lo : hi + 1]) + lo
        if len(places):  # nearest boundary of the best kind near the landmark: kind counts more than a quarter of the range
            cost = np.abs(places - landmark) / (hi - lo + 1) - 4 * weight[places]
            end = int(places[np.argmin(cost)])
        else:
            end = landmark if landmark > lo else hi
            end = hi if hi - end > (hi - lo) // 2 else end
        out.append((start, end))
        start = end - back
    return [*out, (start, n)]


def pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id, piece_no (from 1), n_pieces, char_start, char_end, token_count, text of every chunk.

    ``limits`` has one row for each profile; it is joined by Catalyst, which broadcasts it below its own size threshold.
    """
    rows = limited(chunks.select("chunk_id", "profile", "text").dropDuplicates(["chunk_id"]), limits)

    def run(rows) -> Iterator[tuple]:
        for chunk_id, text, most, overlap in rows:
            if text and most is not None:
                parts = cut(text, most, overlap or 0)
                for k, (a, b) in enumerate(parts):
                    yield chunk_id, k + 1, len(parts), a, b, tokens(b - a), text[a:b]

    return arrow_rows(rows, "chunk_id bigint, piece_no int, n_pieces int, char_start int, char_end int, token_count int, text string", run)


def limited(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id, text, max_tokens, overlap_tokens of every chunk whose profile has a limit."""
    return chunks.join(limits.select("profile", "max_tokens", "overlap_tokens").dropDuplicates(["profile"]), "profile").select("chunk_id", "text", "max_tokens", "overlap_tokens")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id of the chunks that had to be cut. Texts stay where the scan puts them; only ids are made distinct."""

    def run(rows) -> Iterator[tuple]:
        for chunk_id, text, most, overlap in rows:
            if text and most is not None and len(cut(text, most, overlap or 0)) > 1:
                yield (chunk_id,)

    return arrow_rows(limited(spread(chunks.select("chunk_id", "profile", "text"), "chunk_id"), limits), "chunk_id bigint", run).distinct()
