"""Mentions of one person in a document share a placeholder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velario.functions.text import fold_accents
from velario.operators.roles import placeholder

TITLES = r"(?iU)\b(?:dr|dra|sr|sra|srta|don|do[ñn]a|lic|ing|prof|cdor|cra)\.?\s+"


def normalize_name(name: Column) -> Column:
    """Small letters without accents, titles and marks; one blank between words."""
    x = F.lower(fold_accents(F.regexp_replace(F.trim(name), TITLES, "")))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def cluster_key(name: Column, comma_aware: bool = False) -> Column:
    """The last word of the normalised name, or its only one; with ``comma_aware`` the last word before a comma."""
    n = normalize_name(F.substring_index(name, ",", 1) if comma_aware else name)
    return F.when(n != "", F.element_at(F.split(n, " "), -1))


def clusters(classified: DataFrame, policy: DataFrame, comma_aware: bool = False, count_by: str = "prefix") -> DataFrame:
    """doc_id, key, role, confidence, first_card, n_mentions, sample, placeholder.

    One aggregation on (document, key), with partial aggregation before its shuffle: the role of the first mention, or of the first with
    the highest confidence if roles differ. Clusters are numbered by prefix in order of their first mention, so that no two persons share a
    placeholder; ``count_by="role"`` counts each role for itself.
    """
    keyed = classified.withColumn("key", F.coalesce(cluster_key(F.col("text"), comma_aware), F.concat(F.lit("__singleton_"), F.col("card_id").cast("string"))))
    c = keyed.groupBy("doc_id", "key").agg(
        F.min("card_id").alias("first_card"),
        F.count("*").alias("n_mentions"),
        (F.min("role") != F.max("role")).alias("_mixed"),  # a distinct count would shuffle twice
        F.min_by(F.struct("role", "confidence", "text"), "card_id").alias("_first"),
        F.max_by(F.struct("role", "confidence"), F.struct("confidence", -F.col("card_id"))).alias("_best"),
    )
    best = F.col("_mixed")
    c = c.select(
        "doc_id", "key", F.when(best, F.col("_best.role")).otherwise(F.col("_first.role")).alias("role"), F.when(best, F.col("_best.confidence")).otherwise(F.col("_first.confidence")).alias("confidence"), "first_card",
        "n_mentions", F.col("_first.text").alias("sample"),
    )
    c = c.join(F.broadcast(policy.select("role", "prefix")), "role", "left")
    w = Window.partitionBy("doc_id", count_by).orderBy("first_card")
    return c.select("doc_id", "key", "role", "confidence", "first_card", "n_mentions", "sample", placeholder(F.col("prefix"), F.when(F.col("prefix").isNotNull(), F.row_number().over(w))).alias("placeholder"))


def replacements(classified: DataFrame, found: DataFrame, comma_aware: bool = False) -> DataFrame:
    """doc_id, start, end, replacement of the mentions that are anonymised; a mixed cluster whose mention is kept is marked in ``mixed``."""
    keyed = classified.withColumn("key", F.coalesce(cluster_key(F.col("text"), comma_aware), F.concat(F.lit("__singleton_"), F.col("card_id").cast("string"))))
    j = keyed.drop("role", "confidence").join(found.select("doc_id", "key", "placeholder"), ["doc_id", "key"])
    return j.where("anonymize and placeholder is not null").select("doc_id", "start", "end", F.col("placeholder").alias("replacement"))


def audit(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("key").alias("cluster_key"), "role", "placeholder", F.bround("confidence", 3).alias("confidence"), F.col("n_mentions").alias("n_menciones"), "sample")
