"""Cited authors and case names, which must be preserved.

A citation is read from its words: what stands around a trigger, a year or a versus mark is cut into words or parts first, each is
told a name, a link or something else, and the run of names is taken from there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions.text import UNICODE_I, find_all, let
from velario.operators.spans import no_spans, span

#: Phrases before a cited author, how far after them a name is sought, most names of an author, least length.
TRIGGER = UNICODE_I + r"\b(?:ver\s+doctrina\s+de|conf(?:orme)?\.|cfr?\.|seg[uú]n\s+ense[ñn]a|en\s+palabras\s+de)\s+"
REACH, MOST_NAMES, LEAST = 80, 4, 3
#: Parts between author and year and their length; lengths of the sides of a case name.
MOST_PARTS, LONGEST_PART = 3, 40
FIRST_SIDE, SECOND_SIDE = (4, 120), (2, 120)
CAPITAL, SMALL = "A-ZÁÉÍÓÚÑ", "a-záéíóúñ"
LINKS = ("de", "del", "la", "y")


def _kept(start: Column, text: Column, role: str) -> Column:
    return span(start=start, end=start + F.length(text), text=text, type=F.lit(role), source=F.lit("structure"), confidence=F.lit(0.95), preserve=F.lit(True), default_role=F.lit(role))


def _kind(word: Column) -> Column:
    """n: a name; e: a name with a mark after it, so the last one; l: a link; x: anything else."""
    name = rf"[{CAPITAL}][{SMALL}]+"
    return F.when(word.isin(*LINKS), "l").when(word.rlike(rf"^{name}$"), "n").when(word.rlike(rf"^{name}(?![{CAPITAL}{SMALL}])"), "e").otherwise("x")


def _after_trigger(text: Column) -> Column:
    """The run of names that opens the text after each trigger."""

    def of(m: Column) -> Column:
        def in_words(tokens: Column) -> Column:
            kinds = F.array_join(F.transform(tokens, lambda t: _kind(t["text"])), "")
            run = F.length(F.regexp_extract(kinds, rf"^(?:n(?:l?n){{0,{MOST_NAMES - 2}}}(?:l?[ne])?|e)", 0))
            return let(F.when(run > 0, F.element_at(tokens, run)), lambda last: last["start"] + F.length(F.regexp_extract(last["text"], rf"^[{CAPITAL}{SMALL}]+", 0)))

        def named(near: Column) -> Column:
            return let(F.substring(near, F.lit(1), let(find_all(near, r"(?U)\S+"), in_words)), lambda name: F.when(name.isNotNull(), _kept(m["end"], name, "AUTOR_DOCTRINA")))

        return let(F.substring(text, m["end"] + 1, REACH), named)

    return F.filter(F.transform(find_all(text, TRIGGER), of), lambda s: s.isNotNull() & (F.length(s["text"]) >= LEAST))


def _before_year(text: Column) -> Column:
    """SURNAME, work, year: of the parts between commas before a year, the run of names that ends the earliest one in reach."""
    name = rf"(?<![\p{{L}}\p{{N}}_])[{CAPITAL}][{CAPITAL}{SMALL}]+(?:\s+[{CAPITAL}][{SMALL}]+){{0,{MOST_NAMES - 1}}}$"

    def in_parts(parts: Column) -> Column:
        years = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(r"^\s*(?:19|20)\d{2}(?!\w)"), i)), lambda i: i > 0)

        def of(y: Column, before: Column) -> Column:
            first = F.greatest(y - MOST_PARTS - 1, before)
            near = F.transform(F.slice(parts, first + 1, y - first), lambda p, k: F.struct((first + k).alias("i"), F.regexp_extract(p, name, 0).alias("name"), (F.length(F.ltrim(p)) > LONGEST_PART).alias("long")))
            # parts behind the author's own must be short
            return let(near, lambda ps: F.try_element_at(F.filter(ps, lambda p: (p["name"] != "") & ~F.exists(ps, lambda o: o["long"] & (o["i"] > p["i"]))), F.lit(1)))

        def placed(a: Column) -> Column:
            return _kept(F.length(F.array_join(F.slice(parts, 1, a["i"] + 1), ",")) - F.length(a["name"]), a["name"], "AUTOR_DOCTRINA")

        found = let(years, lambda ys: F.transform(ys, lambda y, k: of(y, F.when(k > 0, F.try_element_at(ys, k)).otherwise(0))))
        return F.transform(F.filter(found, lambda a: a.isNotNull()), placed)

    return let(F.split(F.coalesce(text, F.lit("")), ",", -1), in_parts)


def doctrine_authors(text: Column) -> Column:
    """Authors after a trigger, and authors before their work and its year."""
    return F.concat(_after_trigger(text), _before_year(text))


def case_names(text: Column) -> Column:
    """Quoted names of cases, whole: a quotation whose sides of a versus or matter mark have the lengths of names."""

    def sides(m: Column) -> Column:
        marks = find_all(m["group"], r"(?d)\s(?:c/|s/|vs\.?)\s")
        n = F.length(m["group"])
        return F.exists(
            marks, lambda x: F.length(F.rtrim(F.substring(m["group"], F.lit(1), x["start"]))).between(*FIRST_SIDE) & (n - x["end"]).between(*SECOND_SIDE)
        )

    return F.transform(F.filter(find_all(text, '["“]([^"“”]+)["”]', 1), sides), lambda m: _kept(m["start"] + 1, m["group"], "AUTOR_JURISPRUDENCIA"))


def citations(text: Column) -> Column:
    return F.when(text.isNull(), no_spans()).otherwise(F.concat(doctrine_authors(text), case_names(text)))
