"""Replacements of a text carried over to the runs it was put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_edits(runs: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id, part, run_index, old_text, new_text of the runs that change.

    An interval join inside each document (equality on doc_id shuffles, the interval is the residual condition): of the runs that a
    replacement touches, the first keeps what stands before it and takes the replacement, those between lose their text, the last keeps
    what stands behind it. Then each run is put together from its pieces in order of the offsets.
    """
    r = runs.where("text is not null and text <> ''").select("doc_id", "part", "run_index", F.col("text").alias("old_text"), F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    p = replacements.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "replacement")
    touched = r.join(p, "doc_id").where((F.col("b") > F.col("s")) & (F.col("a") < F.col("e")))
    piece = F.struct(
        F.greatest(F.col("s") - F.col("a"), F.lit(0)).alias("from"),
        F.least(F.col("e") - F.col("a"), F.length("old_text")).alias("to"),
        F.when(F.col("s") >= F.col("a"), F.col("replacement")).otherwise(F.lit("")).alias("put"),
    )
    # a replacement that begins in the separator before a run is put at the start of the first run it touches
    first = touched.groupBy("doc_id", "s", "e").agg(F.min("a").alias("first_a"))
    touched = touched.join(first, ["doc_id", "s", "e"])
    piece = piece.withField("put", F.when(F.col("a") == F.col("first_a"), F.col("replacement")).otherwise(F.lit("")))
    edits = touched.groupBy("doc_id", "part", "run_index", "old_text").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(F.col("old_text"), acc["at"] + 1, x["from"] - acc["at"]), x["put"]).alias("out"), x["to"].alias("at")
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("old_text"), acc["at"] + 1, F.length("old_text")))
    return edits.select("doc_id", "part", "run_index", "old_text", F.aggregate("pieces", zero, step, rest).alias("new_text"))


def offsets(runs: DataFrame, order: list[str], separator: Column | None = None) -> DataFrame:
    """char_start and char_end of runs laid one after another within a document, after an optional separator before each."""
    from pyspark.sql import Window

    sep = separator if separator is not None else F.lit(0)
    w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.length("text") + sep).over(w)
    return runs.withColumn("char_end", total.cast("int")).withColumn("char_start", (F.col("char_end") - F.length("text")).cast("int"))
