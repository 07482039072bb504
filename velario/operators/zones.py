"""Zones of a ruling: caption, signature block, citations; and the zone that holds a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velario.functions.text import UNICODE_I, UNICODE_IM, find_all, find_from

ZONE = "struct<name:string,start:int,end:int,default_role:string,evidence:string>"
#: Headings that open the body of a ruling, marks that open its signature, courts and doctrine triggers (fixed values).
BODY = UNICODE_IM + r"^\s*(?:Y\s+VISTOS?|VISTO|RESULTA|RESULTANDO|I\s*[\.\-]\s*DEMANDA|I\s*[\.\-]\s*ANTECEDENTES|AUTOS\s+Y\s+VISTOS|CONSIDERANDO)\s*[:.]"
SIGNATURE = (
    UNICODE_I
    + r"(?:PROTOCOL[IÍ]CESE|Es\s+copia(?:\s+fiel)?|Texto\s+Firmado\s+digitalmente\s+por|Firmado(?:\s+digitalmente)?\s*:|Notif[ií]quese\s+y\s+arch[ií]vese|REG[IÍ]STRESE\s+Y\s+NOTIF[IÍ]QUESE)"
)
COURTS = UNICODE_I + r"(?:CSJN[,\s]|Fallos:\s*\d+|CNCiv\.|CNCom\.|CNCrim\.|CNCAF\.|TSJ\s+\w+|C[aá]m\.\s*(?:Civ|Com|Crim|Apel)|C\.\s*Nac\.\s*(?:Civ|Com|Crim))"
DOCTRINE = UNICODE_I + r"(?:ver\s+doctrina\s+de\s+|conf\.\s+|cf(?:r)?\.\s+|seg[uú]n\s+ense[ñn]a\s+|en\s+palabras\s+de\s+)"
CAPTION_CHARS, PARTY_CHARS, SIGNATURE_SHARE = 800, 1500, 0.7
PRIORITY = {"CITA_DOCTRINA": 100, "CITA_JURISPRUDENCIA": 100, "FIRMA": 50, "CARATULA": 50}


def _zone(name: str, start: Column, end: Column, role: str, evidence: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(role).alias("default_role"), evidence.alias("evidence"))


def no_zones() -> Column:
    return F.expr(f"cast(array() as array<{ZONE}>)")


def caption_end(text: Column, fallback: int) -> Column:
    """Where the caption ends: at the first heading of the body, else after ``fallback`` characters."""
    before = F.split(text, BODY, 2)
    end = F.when(F.size(before) > 1, F.length(before[0])).otherwise(F.least(F.lit(fallback), F.length(text)))
    return F.when(text.isNotNull(), end)  # least() passes over nulls


def caption(text: Column) -> Column:
    end = caption_end(text, CAPTION_CHARS)
    first = F.regexp_extract(text, BODY, 0)
    return F.when(end > 0, F.array(_zone("CARATULA", F.lit(0), end, "PARTE", F.when(first != "", first).otherwise(F.lit("(fallback 800 chars)"))))).otherwise(no_zones())


def signature(text: Column) -> Column:
    """From the last mark to the end, if the mark lies in the last part of a text that is not short."""
    last = F.try_element_at(find_all(text, SIGNATURE), F.lit(-1))
    early = (F.length(text) > 300) & (last["start"] < F.floor(F.length(text) * SIGNATURE_SHARE))
    return F.when(last.isNotNull() & ~early, F.array(_zone("FIRMA", last["start"], F.length(text), "JUEZ", last["text"]))).otherwise(no_zones())


def _windows(text: Column, pattern: str, name: str, role: str, window: int, least: int) -> Column:
    def one(m: Column) -> Column:
        end = F.least(m["start"] + window, F.length(text))
        dot = find_from(text, ". ", m["start"] + least, end)
        return _zone(name, m["start"], F.when(dot >= 0, dot + 1).otherwise(end), role, m["text"])

    return F.transform(find_all(text, pattern), one)


def jurisprudence(text: Column) -> Column:
    return _windows(text, COURTS, "CITA_JURISPRUDENCIA", "AUTOR_JURISPRUDENCIA", 250, 30)


def doctrine(text: Column) -> Column:
    return _windows(text, DOCTRINE, "CITA_DOCTRINA", "AUTOR_DOCTRINA", 200, 20)


def zones(text: Column) -> Column:
    """All zones; they may overlap."""
    return F.when(F.coalesce(text, F.lit("")) == "", no_zones()).otherwise(F.concat(caption(text), signature(text), jurisprudence(text), doctrine(text)))


def rank(name: Column) -> Column:
    out = F.lit(0)
    for k, v in PRIORITY.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def zone_at(offset: Column, zs: Column) -> Column:
    """The most specific zone that holds a place, or null: citations first, then the shortest, then the first."""
    inside = F.filter(F.transform(zs, lambda z, i: F.struct((-rank(z["name"])).alias("p"), (z["end"] - z["start"]).alias("n"), i.alias("i"), z.alias("z"))), lambda k: (k["z"]["start"] <= offset) & (offset < k["z"]["end"]))
    return F.array_min(inside)["z"]


def assign_zones(points: DataFrame, zone_rows: DataFrame, key: str = "doc_id", at: str = "start") -> DataFrame:
    """The same as a join: points ⟕ zones of the same document that hold them, best zone kept.

    The equality on the document is the shuffle key, so that the interval test runs inside a document only. Equally long zones
    go by ``ord`` of the zones, where they have it.
    """
    p = points.withColumn("_row", F.monotonically_increasing_id())
    z = zone_rows.select(F.col(key).alias("_k"), F.col("name").alias("zone_hint"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("default_role").alias("zone_default_role"), (F.col("ord") if "ord" in zone_rows.columns else F.lit(0)).alias("_o"))
    j = p.join(z, (p[key] == z["_k"]) & (z["_a"] <= p[at]) & (p[at] < z["_b"]), "left")
    w = Window.partitionBy("_row").orderBy(F.desc(rank(F.col("zone_hint"))), F.col("_b") - F.col("_a"), "_o", "_a", "zone_hint")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_row", "_k", "_a", "_b", "_o")
