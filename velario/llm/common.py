"""Helpers shared by the text operators: Arrow mapping, spreading of small inputs, words, bounded vocabularies."""

from __future__ import annotations

import re
import tempfile
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_ACCENT = re.compile("[̀-ͯ]")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir; one of its own only in local mode where none is named (as in tests), else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="velario-checkpoints-"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by unique keys only while the scan has fewer partitions than the cluster has cores.

    A large input is split by the scan itself and is left alone, so this shuffle never happens at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < cores else df


def arrow_rows(df: DataFrame, schema: str, fn: Callable[[Iterable[tuple]], Iterator[tuple]], size: int = 512) -> DataFrame:
    """mapInArrow over tuples: ``fn`` gets the rows of a slice of at most ``size`` rows and yields output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = list(fn(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def fold(text: str) -> str:
    """Case and accents removed; what remains keeps its order."""
    text = text.casefold()
    return text if text.isascii() else _ACCENT.sub("", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """Folded words: longest runs of letters and digits."""
    return WORD.findall(fold(text)) if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a fixed number of entries."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = np.empty(len(tokens), np.uint64)
        for i, w in enumerate(tokens):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    """Odd 64-bit multipliers, the same in every process."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


#: A word is ordinary from this share of all words on (and from ``least`` occurrences in tables too small for a share): at most
#: 1 / SHARE words can reach it, so what is collected and broadcast is bounded at every size, and nothing is cut off by a rank.
SHARE = 5e-7


def vocabulary(texts: list[DataFrame], least: int = 3, share: float = SHARE, letters: str = r"a-zA-ZáéíóúñüÁÉÍÓÚÑÜ") -> dict[str, int]:
    """Counts of the ordinary words over all rows of one-column tables, by JVM expressions.

    Every row is counted (partial aggregation before the shuffle); what reaches the driver is bounded by ``1 / share`` words.
    """
    counted = None
    for df in texts:
        column = df.columns[0]
        part = df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}\\p{{S}}\\p{{Cf}}])[{letters}]{{2,}}(?![\\p{{L}}\\p{{M}}\\p{{N}}\\p{{S}}\\p{{Cf}}])"), F.lit(0))).alias("w"))
        counted = part if counted is None else counted.unionAll(part)
    counts = counted.groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()  # a scalar subquery over the same exchange
    rows = counts.where((F.col("n") >= least) & (F.col("n") >= total * F.lit(share))).collect()
    return {r.w: r.n for r in sorted(rows, key=lambda r: (-r.n, r.w))}
