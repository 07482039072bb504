"""The full pipeline: identifiers, zones, citations, caption and entities; roles from predictions; persons with one placeholder each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.operators import caption, cards, citations, coref, entities, identifiers, predict, validate, zones
from velario.operators.spans import REPLACEMENTS, apply_replacements, no_spans, numbered, resolve_overlaps

ENTITIES = "array<struct<start:int,end:int,label:string>>"


def detected(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Documents with zones and resolved spans. ``found``: doc_id, start, end, label of an entity recogniser; without it the pipeline goes on
    with what structure gives."""
    d = docs
    if found is not None:
        e = found.where("label is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("entities"))
        d = d.join(e, "doc_id", "left")
    else:
        d = d.withColumn("entities", F.expr(f"cast(null as {ENTITIES})"))
    t = F.col("text")
    ner = F.when(F.col("entities").isNotNull(), entities.entity_spans(t, F.col("entities"))).otherwise(no_spans())
    d = d.withColumn("zones", zones.zones(t)).withColumn("spans", resolve_overlaps(F.concat(identifiers.identifiers(t), citations.citations(t), caption.caption_spans(t), ner)))
    return d.withColumn("cards", cards.cards(t, F.col("spans"), F.col("zones"))).drop("entities")


def full(docs: DataFrame, said: DataFrame, policy: DataFrame, found: DataFrame | None = None, batch: int = predict.BATCH) -> DataFrame:
    """doc_id, n_spans, n_cards, n_clusters, replacements, redacted, issues, success.

    said: doc_id, batch_no, raw, error: the answers to ``predict.requests``. Per-document work stays in the row; cards leave it once for
    the join with the answers and the clustering, both on doc_id.
    """
    d = detected(docs, found).persist()  # read by the cards and by the replacement; kept in memory or on disk, made anew if lost
    rows = predict.classified(cards.explode_cards(d, "doc_id"), said, policy, batch)
    clusters = coref.clusters(rows, policy)
    people = coref.replacements(rows, clusters).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("people"))
    n = clusters.groupBy("doc_id").agg(F.count("*").alias("n_clusters"))
    d = d.join(people, "doc_id", "left").join(n, "doc_id", "left")
    ids = numbered(F.filter("spans", lambda s: s["source"] == "regex"))
    d = d.withColumn("replacements", F.array_sort(F.concat(ids, F.coalesce("people", F.expr(f"cast(array() as {REPLACEMENTS})")))))
    d = d.withColumn("redacted", apply_replacements(F.col("text"), F.col("replacements")))
    expected = F.array_distinct(F.transform("replacements", lambda r: r["replacement"]))
    d = d.withColumn("issues", validate.text_issues(F.col("text"), F.col("redacted"), expected))
    return d.select(
        "doc_id", F.size("spans").cast("bigint").alias("n_spans"), F.size("cards").cast("bigint").alias("n_cards"), F.coalesce("n_clusters", F.lit(0)).cast("bigint").alias("n_clusters"), "replacements", "redacted", "issues",
        validate.passed(F.col("issues")).alias("success"),
    )


def stages(result: DataFrame) -> DataFrame:
    """stage, n_items over a batch."""
    return result.agg(F.sum("n_spans").alias("resolve"), F.sum("n_cards").alias("cards"), F.sum("n_clusters").alias("coreference"), F.sum(F.size("replacements")).alias("replacements")).unpivot(
        [], ["resolve", "cards", "coreference", "replacements"], "stage", "n_items"
    )
