"""Entity cards: what a classifier is shown of each span that needs a role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.operators.zones import zone_at

CONTEXT = 200


def cards(text: Column, spans: Column, zones: Column, context: int = CONTEXT) -> Column:
    """array<card> of the spans that are neither identifiers nor preserved, numbered from 1 in order of the input."""
    open_ = F.filter(spans, lambda s: (s["source"] != "regex") & ~F.coalesce(s["preserve"], F.lit(False)))

    def one(s: Column, i: Column) -> Column:
        z = zone_at(s["start"], zones)
        left = F.greatest(s["start"] - context, F.lit(0))
        return F.struct(
            (i + 1).alias("card_id"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["text"].alias("text"),
            F.substring(text, left + 1, s["start"] - left).alias("context_left"),
            F.substring(text, s["end"] + 1, F.lit(context)).alias("context_right"),
            z["name"].alias("zone_hint"),
            F.coalesce(s["role_hint"], z["default_role"]).alias("zone_default_role"),
            F.when(s["source"] == "ner", s["type"]).alias("ner_type"),
        )

    return F.transform(open_, one)


def explode_cards(docs: DataFrame, *keys: str, column: str = "cards") -> DataFrame:
    # explode_outer, then a filter on what comes out: a filter derived from explode would work the cards out twice
    return docs.select(*keys, F.explode_outer(column).alias("c")).where("c is not null").select(*keys, "c.*")


def prompt(card: Column) -> Column:
    """A card as JSON, empty fields left out."""
    fields = {
        "id": card["card_id"], "entidad": card["text"], "contexto_izq": card["context_left"], "contexto_der": card["context_right"], "zona": card["zone_hint"], "pista_rol": card["zone_default_role"],
        "tipo_ner": card["ner_type"],
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "true"})
