"""Figures of a batch of audits: one pass of aggregates, and documents redacted too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("stem", "n_pages", "text_chars", "n_parties", "n_replacements", "repl_per_page", "repl_per_kchar", "elapsed_s", "model", "has_warnings", "success")


def doc_metrics(audits: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """A row for each audit with defaults for what is missing: 0, 0.0, "?" and false."""
    d = audits.select(
        F.col("audit_id"), F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"), F.coalesce("text_chars", F.lit(0)).cast("bigint").alias("text_chars"),
        F.coalesce("n_replacements", F.lit(0)).cast("bigint").alias("n_replacements"), F.coalesce("replacements_per_page", F.lit(0.0)).alias("replacements_per_page"),
        F.coalesce("replacements_per_kchar", F.lit(0.0)).alias("replacements_per_kchar"), F.coalesce("elapsed_s", F.lit(0.0)).alias("elapsed_s"), F.coalesce("model", F.lit("?")).alias("model"),
        (F.size(F.coalesce("warnings", F.expr("cast(array() as array<string>)"))) > 0).alias("has_warnings"), F.coalesce("success", F.lit(False)).alias("success"),
    )
    if parties is None:
        return d.withColumn("n_parties", F.lit(0).cast("bigint"))
    n = parties.groupBy("audit_id").agg(F.countDistinct("party_id").alias("n_parties"))
    return d.join(n, "audit_id", "left").withColumn("n_parties", F.coalesce("n_parties", F.lit(0)).cast("bigint"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row: counts, distinct models, averages, exact medians and sample deviation. The rates count audits with pages only."""
    rate = F.when(F.col("n_pages") > 0, F.col("replacements_per_kchar"))
    return metrics.agg(
        F.count("*").alias("total"), F.count_if("has_warnings").alias("with_warnings"), F.count_if(F.col("n_replacements") == 0).alias("zero_replacements"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"), F.bround(F.avg("n_replacements"), 1).alias("avg_replacements"), F.median("n_replacements").alias("median_replacements"),
        F.bround(F.avg("elapsed_s"), 2).alias("avg_elapsed_s"), F.bround(F.sum("elapsed_s"), 1).alias("total_elapsed_s"), F.bround(F.coalesce(F.median(rate), F.lit(0.0)), 2).alias("median_repl_per_kchar"),
        F.bround(F.coalesce(F.stddev_samp(rate), F.lit(0.0)), 2).alias("stdev_repl_per_kchar"),
    )


def z_score(x: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation == 0, F.lit(0.0)).otherwise(F.try_divide(x - mean, deviation))


def outliers(metrics: DataFrame, z: float = 2.0) -> DataFrame:
    """Audits with warnings, and longer ones whose rate lies more than ``z`` deviations below the mean of clean audits with pages.

    The figures are one row, broadcast to the scan. Fewer than five audits give none.
    """
    base = (F.col("n_pages") > 0) & ~F.col("has_warnings")
    stats = metrics.agg(
        F.count("*").alias("n"), F.avg(F.when(base, F.col("replacements_per_kchar"))).alias("mean"), F.coalesce(F.stddev_samp(F.when(base, F.col("replacements_per_kchar"))), F.lit(0.0)).alias("deviation")
    )
    low = (F.col("n_pages") > 2) & (F.col("replacements_per_kchar") < F.col("mean") - z * F.col("deviation"))
    rows = metrics.join(F.broadcast(stats)).where((F.col("n") >= 5) & F.col("mean").isNotNull() & (F.col("has_warnings") | low))
    return rows.select(
        *metrics.columns, F.when(F.col("has_warnings"), F.lit("warning")).otherwise(F.lit("low_density")).alias("reason"),
        F.when(~F.col("has_warnings"), z_score(F.col("replacements_per_kchar"), F.col("mean"), F.col("deviation"))).alias("z"),
    )


def for_csv(metrics: DataFrame, stem: Column) -> DataFrame:
    """The eleven columns of the export, truth values as 0 and 1."""
    return metrics.select(
        stem.alias("stem"), "n_pages", "text_chars", "n_parties", "n_replacements", F.col("replacements_per_page").alias("repl_per_page"), F.col("replacements_per_kchar").alias("repl_per_kchar"), "elapsed_s", "model",
        F.col("has_warnings").cast("int").alias("has_warnings"), F.col("success").cast("int").alias("success"),
    )


def tally(outcomes: DataFrame) -> DataFrame:
    """ok, review, error, total, exit_code, total_s, average_s of return codes: 0 is ok, 2 review, anything else an error."""
    ok, review = F.count_if(F.col("rc") == 0), F.count_if(F.col("rc") == 2)
    error = F.count("*") - ok - review
    return outcomes.agg(
        ok.alias("ok"), review.alias("review"), error.alias("error"), F.count("*").alias("total"), F.when(error > 0, 1).when(review > 0, 2).otherwise(0).alias("exit_code"), F.sum("elapsed_s").alias("total_s"),
        F.avg("elapsed_s").alias("average_s"),
    )


def rates(n: Column, pages: Column, chars: Column) -> tuple[Column, Column]:
    """Replacements per page and per thousand characters, two digits; 0 without pages or characters."""
    return (
        F.when(F.coalesce(pages, F.lit(0)) > 0, F.bround(F.try_divide(n, pages), 2)).otherwise(F.lit(0.0)),
        F.when(F.coalesce(chars, F.lit(0)) > 0, F.bround(F.try_divide(n * 1000, chars), 2)).otherwise(F.lit(0.0)),
    )
