"""Problem 8: encoding of a corpus with a public byte-level BPE vocabulary.

Method: batched numpy merge rounds. The symbols of all distinct new words of a batch lie in one flat array; each round
finds the lowest-rank pair of every word by binary search over sorted pair keys and merges all its occurrences. Words of more
than ``LONG`` characters, which would need very many rounds, are merged one by one from a heap of the same pairs.

Defined results: null and empty texts give an empty list; every row of the input gives one row; strings of special tokens
are ordinary text; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import spread

#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer unbroken words are merged one by one.
LONG = 400
NO_PAIR = np.int64(1 << 40)


class Bpe:
    """Merge tables as arrays: small (about 1.5 MB), of fixed size, and cheap to send to the executors."""

    def __init__(self, directory: str = "/opt/tokenizers", name: str = "byte_bpe_50k"):
        model = json.loads((Path(directory) / f"{name}.json").read_text())["model"]
        ids = model["vocab"]
        ranks = dict(map(bytes.split, (Path(directory) / f"{name}.tiktoken").read_bytes().splitlines()))
        self.first = np.zeros(256, np.int64)
        for token, rank in ranks.items():
            if len(b := base64.b64decode(token)) == 1:
                self.first[b[0]] = int(rank)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.seen: dict[str, list[int]] = {}
        self.table: dict[int, tuple[int, int]] | None = None

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "table": None}

    def _long(self, raw: bytes) -> list[int]:
        """One long word: a heap of pairs over a linked list, as rounds over the whole word would take quadratic time."""
        if self.table is None:
            self.table = {int(k): (int(r), int(self.merged[r])) for k, r in zip(self.keys, self.rank, strict=True)}
        table = self.table
        sym = [int(x) for x in self.first[np.frombuffer(raw, np.uint8)]]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(table[k][0], i, k) for i in range(n - 1) if (k := sym[i] << 20 | sym[i + 1]) in table]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or sym[i] << 20 | sym[j] != key:  # one of the two has been merged since
                continue
            sym[i], sym[j] = table[key][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := sym[a] << 20 | sym[b]) in table:
                    heapq.heappush(heap, (table[k][0], a, k))
        return [x for x in sym if x >= 0]

    def _learn(self, new: list[str]) -> None:
        """Encode distinct words in merge rounds and remember them."""
        for w in [w for w in new if len(w) > LONG]:
            self.seen[w] = self._long(w.encode("utf-8", "surrogatepass"))
        new = [w for w in new if len(w) <= LONG]
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        symbols = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(b) for b in raw])
        done_symbols, done_word = [], []
        while len(symbols):
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_PAIR)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], NO_PAIR)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NO_PAIR, sizes)
            if over.any():
                done_symbols.append(symbols[over])
                done_word.append(word[over])
                keep = ~over
                symbols, word, rank, best = symbols[keep], word[keep], rank[keep], best[best != NO_PAIR]
                if not len(symbols):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                sizes = np.diff(np.r_[starts, len(word)])
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # in a run of overlapping hits (same symbol repeated) only every other one merges, from the left
            run = np.r_[True, np.diff(hit) > 1]
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[since % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        for w, x in zip(new, np.split(symbols[order], np.cumsum(np.bincount(word, minlength=len(new)))[:-1]), strict=True):
            self.seen[w] = x.tolist()

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.seen) > 300_000:
            self.seen.clear()
        find = regex.compile(PATTERN).findall
        cut = [find(t) if t else [] for t in texts]
        if new := list({w for ws in cut for w in ws if w not in self.seen}):
            self._learn(new)
        seen = self.seen
        return [[i for w in ws for i in seen[w]] for ws in cut]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", directory: str = "/opt/tokenizers", name: str = "byte_bpe_50k") -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of every row: one narrow Arrow stage, no shuffle beyond spreading a small input."""
    df = spread(df.select(key, text), key)
    held = df.sparkSession.sparkContext.broadcast(Bpe(directory, name))  # fixed size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, ids array<int>")
