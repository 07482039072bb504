"""What may leave the house: names of files, audits without identities, and a last look for leaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions.text import squash


def public_id(content: Column) -> Column:
    """Ten hexadecimal digits of the SHA-1 of a file's content: stable, and free of its name."""
    return F.substring(F.sha1(content), 1, 10)


def public_name(content: Column, extension: Column) -> Column:
    return F.concat(F.lit("documento_"), public_id(content), F.lit("_anonimizado"), F.lower(extension))


def public_audit_name(content: Column) -> Column:
    return F.concat(F.lit("documento_"), public_id(content), F.lit("_audit_publico.json"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def output_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_anonimizado"), F.lower(extension(path)))


def held_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_REVISAR_NO_PUBLICAR"), F.lower(extension(name)))


def failed_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_FAILED"), F.lower(extension(name)))


def leaks(source: Column, replacements: Column, output: Column) -> Column:
    """Originals of replacements (three letters or more, each once, in order) that the output still holds, case and blanks aside."""
    raw, flat = F.lower(output), F.lower(squash(output))
    ordered = F.array_sort(replacements)
    texts = F.filter(F.transform(ordered, lambda r: F.trim(F.substring(source, r["start"] + 1, r["end"] - r["start"]))), lambda t: F.length(t) >= 3)
    keyed = F.transform(texts, lambda t, i: F.struct(F.lower(t).alias("k"), i.alias("i"), t.alias("t")))
    firsts = F.filter(keyed, lambda x: ~F.exists(keyed, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"])))
    return F.transform(F.filter(firsts, lambda x: F.contains(raw, x["k"]) | F.contains(flat, F.lower(squash(x["t"])))), lambda x: x["t"])


def public_parties(parties: Column) -> Column:
    """Parties without their names."""
    return F.transform(parties, lambda p: F.struct(p["rol"].alias("rol"), p["placeholder"].alias("placeholder"), F.coalesce(p["from_caratula"], F.lit(False)).alias("from_caratula")))


def public_warnings(warnings: Column) -> Column:
    """Warnings without quoted samples."""
    return F.transform(warnings, lambda w: F.regexp_replace(w, r"'[^']*'|\"[^\"]*\"", "[...]"))
