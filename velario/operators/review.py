"""The review queue: audits beside the latest state of each, and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "approved", "rejected", "needs_fix")


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def queue(originals: DataFrame, audits: DataFrame, outputs: DataFrame, state: DataFrame) -> DataFrame:
    """Originals that have an audit, with their latest state (pending by default) and whether they need a look.

    originals: stem; audits: stem, n_pages, n_replacements, warnings, n_parties; outputs: stem; state: stem, status (one row each).
    """
    j = originals.join(audits, "stem").join(state.select("stem", F.col("status").alias("_s")), "stem", "left").join(outputs.select("stem").distinct().withColumn("_out", F.lit(True)), "stem", "left")
    warned = F.size(F.coalesce("warnings", F.expr("cast(array() as array<string>)"))) > 0
    return j.select(
        "stem", F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"), F.coalesce("n_replacements", F.lit(0)).cast("bigint").alias("n_replacements"), "n_parties", warned.alias("has_warnings"),
        F.coalesce("_s", F.lit("pending")).alias("status"), (warned | (F.coalesce("n_replacements", F.lit(0)) == 0) | F.col("_out").isNull()).alias("is_problematic"),
    )


def shown(entries: DataFrame, wanted: str = "problematic") -> DataFrame:
    """Entries of a filter: problematic, a status, or all for anything else."""
    if wanted == "problematic":
        return entries.where("is_problematic")
    return entries.where(F.col("status") == wanted) if wanted in STATUSES else entries


def counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("all"), F.count_if("is_problematic").alias("problematic"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def valid_update(stem: Column, status: Column) -> Column:
    return (F.coalesce(stem, F.lit("")) != "") & status.isin(*STATUSES)
