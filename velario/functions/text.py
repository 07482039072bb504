"""Column expressions over text: matches with offsets, folding, blanks, capitals. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags under which the patterns mean what they mean elsewhere: Unicode classes, and only a line feed ends a line.
UNICODE, UNICODE_I, UNICODE_IM = "(?Ud)", "(?iUd)", "(?imUd)"
MATCH = "array<struct<start:int,end:int,text:string,group:string,group2:string>>"

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def fold_accents(x: Column) -> Column:
    """Latin letters without their accents; the length stays."""
    return F.translate(F.regexp_replace(x, r"[̀-ͯ]", ""), _ACCENTED, _PLAIN)


def squash(x: Column) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however often the body uses it.

    A Column is a tree: used twice it stands there twice, is analysed twice and, inside a lambda, computed twice. A lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def find_all(text: Column, pattern: Column | str, group: int = 0, group2: int = 0) -> Column:
    """All matches in order with code-point offsets, from the lengths of what lies between them.

    The pattern must not match the empty string. A null text has no matches. A text without a match is scanned once only.
    """
    none = F.expr(f"cast(array() as {MATCH})")

    def in_text(t: Column, p: Column) -> Column:
        pairs = F.zip_with(F.split(t, p, -1), F.regexp_extract_all(t, p, F.lit(0)), lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("m")))
        if group or group2:
            groups = F.zip_with(F.regexp_extract_all(t, p, F.lit(group)), F.regexp_extract_all(t, p, F.lit(group2)) if group2 else F.array(), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            pairs = F.zip_with(pairs, groups, lambda x, g: F.struct(x["skip"].alias("skip"), x["m"].alias("m"), g["a"].alias("a"), (g["b"] if group2 else x["m"]).alias("b")))
        else:
            pairs = F.transform(pairs, lambda x: F.struct(x["skip"].alias("skip"), x["m"].alias("m"), x["m"].alias("a"), x["m"].alias("b")))
        pairs = F.filter(pairs, lambda x: x["m"].isNotNull())  # the part after the last match
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + x["skip"]
            b = a + F.length(x["m"])
            made = F.struct(a.alias("start"), b.alias("end"), x["m"].alias("text"), x["a"].alias("group"), x["b"].alias("group2"))
            return F.struct(b.alias("at"), F.array_append(acc["out"], made).alias("out"))

        return F.when(F.rlike(t, p), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)

    whole = F.coalesce(text, F.lit(""))
    if isinstance(pattern, str):
        return let(whole, lambda t: in_text(t, F.lit(pattern)))
    return let(F.struct(whole.alias("t"), pattern.alias("p")), lambda v: in_text(v["t"], v["p"]))


def find_free(text: Column, pattern: Column) -> Column:
    """``find_all`` for patterns that look at nothing around the match (no anchors, boundaries or lookarounds), in one pass of the pattern.

    Such a match begins at the first place, after the match before it, where its own string stands: the pattern would have matched there.
    """
    none = F.expr(f"cast(array() as {MATCH})")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def in_text(v: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            def made(a: Column) -> Column:
                b = a + F.length(m)
                one = F.struct(a.alias("start"), b.alias("end"), m.alias("text"), m.alias("group"), m.alias("group2"))
                return F.struct(b.alias("at"), F.array_append(acc["out"], one).alias("out"))

            return let(F.call_function("locate", m, v["t"], acc["at"] + 1) - 1, made)

        return F.aggregate(F.regexp_extract_all(v["t"], v["p"], F.lit(0)), start, step, lambda acc: acc["out"])

    return let(F.struct(F.coalesce(text, F.lit("")).alias("t"), pattern.alias("p")), in_text)


def quoted(x: Column) -> Column:
    """A pattern that matches the string itself."""
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def occurrences(text: Column, needle: Column, ignore_case: bool = False) -> Column:
    """Non-overlapping occurrences of a string, as matches."""
    p = F.concat(F.lit(UNICODE_I if ignore_case else ""), quoted(needle))
    here = F.length(needle) > 0
    return F.when(here if ignore_case else here & F.contains(text, needle), find_free(text, p)).otherwise(F.expr(f"cast(array() as {MATCH})"))


def title_case(x: Column) -> Column:
    """A capital after every character that is no letter, small letters elsewhere (so also after apostrophes)."""
    chars = F.split(F.lower(x), "")
    step = lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(acc["letter"], c).otherwise(F.upper(c))).alias("out"), c.rlike(r"\p{L}").alias("letter")
    )
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(False).alias("letter")), step, lambda acc: acc["out"])


def words(x: Column) -> Column:
    """Parts between blanks; an empty or blank text has none."""
    return F.filter(F.split(squash(x), " "), lambda w: w != "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def find_from(text: Column, needle: str, start: Column, end: Column) -> Column:
    """0-based place of a needle wholly inside [start, end), or -1."""
    part = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    at = F.instr(part, needle)
    return F.when(at > 0, start + at - 1).otherwise(F.lit(-1))


def half_even(x: Column, scale: int) -> Column:
    """Rounding to even at ties."""
    return F.bround(x, scale)
