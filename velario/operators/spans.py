"""Spans: their type, resolution of overlaps, numbering of placeholders and replacement in the text.

A document is one row with its spans in an array, so every step below stays inside the row: no shuffle. ``explode_spans`` leaves
that form only where a join needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.functions.text import let

FIELDS = {
    "start": "int", "end": "int", "text": "string", "type": "string", "source": "string", "confidence": "double", "normalized": "string", "formato": "string", "preserve": "boolean",
    "role_hint": "string", "default_role": "string", "from_caratula": "boolean", "placeholder": "string", "party_name": "string", "party_rol": "string",
}
SPAN = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
SPANS = f"array<{SPAN}>"
REPLACEMENTS = "array<struct<start:int,end:int,replacement:string>>"

#: Of overlapping spans the source of the higher number wins (fixed values).
PRIORITY = {"regex": 100, "text_search": 90, "structure": 80, "ner": 60, "llm": 40}
#: Placeholder prefixes of the identifier types (fixed values).
PREFIX = {"DNI": "DNI", "CUIT": "CUIT", "CBU": "CBU", "EMAIL": "EMAIL", "TELEFONO": "TEL", "PATENTE": "PATENTE", "PASAPORTE": "PASAPORTE"}


def span(**fields: Column) -> Column:
    """One span; fields not given are null. Offsets are code points, start inclusive, end exclusive."""
    return F.struct(*[(fields.get(k, F.lit(None))).cast(v).alias(k) for k, v in FIELDS.items()])


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed mapping as an expression."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def priority(s: Column) -> Column:
    return lookup(s["source"], PRIORITY, 0)


def overlaps(a: Column, b: Column) -> Column:
    """Half-open intervals that share a place."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve_overlaps(spans: Column, by_priority: bool = True) -> Column:
    """Disjoint spans: in order of start, a later one displaces the last kept one only with a higher priority, or with the same
    and a greater length; a displaced span frees nothing that was dropped before. Ties keep the order of the input.

    With ``by_priority`` off only the length counts (the sweep of name variants).
    """
    rank = priority if by_priority else (lambda _s: F.lit(0))
    length = lambda s: s["end"] - s["start"]
    keyed = F.transform(
        F.coalesce(spans, no_spans()), lambda s, i: F.struct(s["start"].alias("a"), (-rank(s)).alias("b"), (-length(s)).alias("c"), i.alias("d"), s.alias("s"))
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        wins = (rank(s) > rank(last)) | ((rank(s) == rank(last)) & (length(s) > length(last)))
        return (
            F.when((F.size(kept) == 0) | (s["start"] >= last["end"]), F.array_append(kept, s))
            .when(wins, F.array_append(F.slice(kept, 1, F.size(kept) - 1), s))
            .otherwise(kept)
        )

    return F.aggregate(ordered, no_spans(), step)


def numbered(spans: Column) -> Column:
    """Replacements with [PREFIX_N]: equal texts of a type share a number, numbers follow the first appearance in the text."""
    first = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"))))

    def in_order(ordered: Column) -> Column:
        # distinct (type, text) in order of appearance, numbered within the type: worked out once, then looked up by key
        kinds = F.array_distinct(F.transform(ordered, lambda s: s["type"]))
        values = F.flatten(F.transform(kinds, lambda k: F.transform(F.array_distinct(F.transform(F.filter(ordered, lambda s: s["type"] == k), lambda s: s["text"])), lambda x, n: F.struct(k.alias("k"), x.alias("x"), n.alias("n")))))
        numbers = F.map_from_entries(F.transform(values, lambda v: F.struct(F.concat_ws("\0", v["k"], v["x"]), v["n"] + 1)))

        def shown(n: Column) -> Column:
            def one(s: Column) -> Column:
                prefix = F.coalesce(lookup(s["type"], PREFIX), s["type"])
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), prefix, F.lit("_"), F.element_at(n, F.concat_ws("\0", s["type"], s["text"])), F.lit("]")).alias("replacement"))

            return F.transform(ordered, one)

        return let(numbers, shown)

    return let(first, in_order)


def apply_replacements(text: Column, replacements: Column) -> Column:
    """The text with every replacement made; text outside stays as it is. Overlapping or out-of-range replacements are errors."""
    ordered = F.array_sort(F.coalesce(replacements, F.expr(f"cast(array() as {REPLACEMENTS})")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, r: Column) -> Column:
        bad = F.when(r["end"] > F.length(text), F.raise_error(F.lit("replacement beyond the end of the text")).cast("string")).when(
            (r["start"] < acc["at"]) | (r["end"] < r["start"]), F.raise_error(F.lit("overlapping replacements")).cast("string")
        )
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, r["start"] - acc["at"]), r["replacement"])
        return F.struct(F.coalesce(bad, piece).alias("out"), r["end"].alias("at"))

    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(ordered) == 0, text).otherwise(F.aggregate(ordered, start, step, tail))


def explode_spans(docs: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row for each span, with its place ``ord`` in the document."""
    return docs.select(*keys, F.posexplode_outer(spans).alias("ord", "s")).where("s is not null").select(*keys, "ord", "s.*")
