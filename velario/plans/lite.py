"""The light pipeline: party names from predictions and the caption, searched in the text, replaced by initials; identifiers by numbers.

Everything is one row for each document: one join brings the predicted parties, and no other shuffle follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.functions.text import let, squash
from velario.operators import caption, identifiers, metrics, names, publish, validate
from velario.operators.spans import REPLACEMENTS, apply_replacements, numbered, resolve_overlaps

PARTY = "array<struct<nombre:string,rol:string,from_caratula:boolean>>"
LONG_TEXT = 500


def with_parties(docs: DataFrame) -> DataFrame:
    """``parties``: valid predicted parties, then caption parties that are no company and not named yet (case aside), each once.

    Each step is a column of its own: what a lambda would otherwise work out anew for every element is worked out once for a row.
    """
    d = docs.withColumn("_ready", names.prepared(F.col("text"))).withColumn("_caption", caption.caption_spans(F.col("text")))
    checked = F.transform("said", lambda p: F.struct(names.validated(p["nombre"], F.col("_ready")).alias("nombre"), p["rol"].alias("rol"), F.lit(False).alias("from_caratula")))
    d = d.withColumn("_valid", F.filter(checked, lambda p: p["nombre"].isNotNull()))
    d = d.withColumn("_known", F.transform("_valid", lambda p: F.lower(p["nombre"])))
    found = F.transform(
        "_caption",
        lambda s, i: F.struct(F.trim(s["text"]).alias("nombre"), F.when(s["role_hint"] == "PARTE_ACTORA", "actor").otherwise("demandado").alias("rol"), F.lit(True).alias("from_caratula"), i.alias("i")),
    )
    d = d.withColumn("_fresh", F.filter(found, lambda p: ~names.is_company(p["nombre"]) & ~F.array_contains("_known", F.lower(p["nombre"]))))
    once = F.filter("_fresh", lambda p: ~F.exists("_fresh", lambda q: (F.lower(q["nombre"]) == F.lower(p["nombre"])) & (q["i"] < p["i"])))
    new = F.transform(once, lambda p: F.struct(p["nombre"].alias("nombre"), p["rol"].alias("rol"), p["from_caratula"].alias("from_caratula")))
    d = d.withColumn("parties", F.coalesce(F.concat("_valid", new), F.expr(f"cast(array() as {PARTY})")))
    return d.drop("_ready", "_caption", "_valid", "_known", "_fresh")


def party_spans(text: Column, parties: Column, tokens: Column | None = None, held: Column | None = None) -> Column:
    """Occurrences of every party, with the initials that replace them. ``tokens``, ``held``: ``keyed`` and ``bones`` of the text."""

    def of(p: Column) -> Column:
        forms = F.concat(names.variants(p["nombre"]), names.longer_forms(p["nombre"], text, tokens))
        return let(names.initials(p["nombre"]), lambda short: names.name_spans(text, forms, short, p["nombre"], p["rol"], held))

    return F.flatten(F.transform(parties, of))


def lite(docs: DataFrame, said: DataFrame, safe: bool = False) -> DataFrame:
    """The audit row of every document with its redacted text.

    docs: doc_id, text, page_count, path; said: doc_id, nombre, rol (rows of predictions). Documents of substance without any party get a
    warning and no output; with ``safe`` the output is checked for leaks and held back if one is found.
    """
    parties = said.where("nombre is not null").groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "nombre", "rol"))), lambda p: F.struct(p["nombre"].alias("nombre"), F.coalesce(F.lower(F.trim(p["rol"])), F.lit("desconocido")).alias("rol"))).alias("said")
    )
    d = docs.join(parties, "doc_id", "left")
    none = F.expr("cast(array() as array<struct<nombre:string,rol:string>>)")
    d = with_parties(d.withColumn("said", F.coalesce("said", none)))
    d = d.withColumn("_tokens", names.keyed(F.col("text"))).withColumn("_bones", names.bones(F.col("text")))
    d = d.withColumn("regex_spans", identifiers.identifiers(F.col("text"))).withColumn("name_spans", party_spans(F.col("text"), F.col("parties"), F.col("_tokens"), F.col("_bones"))).drop("_tokens", "_bones")
    d = d.withColumn("spans", resolve_overlaps(F.concat("regex_spans", "name_spans")))
    ids = numbered(F.filter("spans", lambda s: s["source"] == "regex"))
    people = F.transform(F.filter("spans", lambda s: s["source"] == "text_search"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["placeholder"], F.lit("[PERSONA]")).alias("replacement")))
    d = d.withColumn("replacements", F.array_sort(F.concat(ids, people)))
    unnamed = (F.size("parties") == 0) & (F.length(squash(F.coalesce("text", F.lit("")))) > LONG_TEXT)
    d = d.withColumn("warnings", F.when(unnamed, F.array(F.lit("REVISION MANUAL REQUERIDA: no parties identified"))).otherwise(F.expr("cast(array() as array<string>)")))
    d = d.withColumn("redacted", F.when(~unnamed, apply_replacements(F.col("text"), F.col("replacements"))))
    if safe:
        held = publish.leaks(F.col("text"), F.col("replacements"), F.col("redacted"))
        d = d.withColumn("leaks", F.coalesce(held, F.expr("cast(array() as array<string>)")))
        d = d.withColumn("warnings", F.when(F.size("leaks") > 0, F.array_append("warnings", F.concat(F.lit("REVISION MANUAL REQUERIDA: leaks "), F.size("leaks").cast("string")))).otherwise(F.col("warnings")))
    per_page, per_kchar = metrics.rates(F.size("replacements"), F.col("page_count"), F.length("text"))
    return d.select(
        "doc_id", F.lit("lite").alias("mode"), "path", F.when(F.col("redacted").isNotNull() & (F.size("replacements") > 0), publish.output_name(F.col("path"))).alias("output"), (F.size("warnings") == 0).alias("success"),
        F.transform("parties", lambda p: F.struct(p["nombre"].alias("nombre"), p["rol"].alias("rol"), names.initials(p["nombre"]).alias("placeholder"), p["from_caratula"].alias("from_caratula"))).alias("parties"),
        F.size("name_spans").cast("bigint").alias("n_name_spans"), F.size("regex_spans").cast("bigint").alias("n_regex_spans"), F.size("replacements").cast("bigint").alias("n_replacements"), "warnings",
        F.coalesce("page_count", F.lit(0)).cast("bigint").alias("n_pages"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("text_chars"), per_page.alias("replacements_per_page"),
        per_kchar.alias("replacements_per_kchar"), F.coalesce("replacements", F.expr(f"cast(array() as {REPLACEMENTS})")).alias("replacements"), "redacted",
    )


def checked(audit: DataFrame, docs: DataFrame) -> DataFrame:
    """The issues of every output against its source."""
    j = audit.select("doc_id", "replacements", "redacted").join(docs.select("doc_id", "text"), "doc_id")
    expected = F.array_distinct(F.transform("replacements", lambda r: r["replacement"]))
    return validate.report(j.withColumn("issues", validate.text_issues(F.col("text"), F.col("redacted"), expected)))
