"""Names of parties: companies, initials, checks against the text, spelling variants and their occurrences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions.text import UNICODE_I, find_free, fold_accents, let, squash, title_case, words
from velario.operators.spans import no_spans, resolve_overlaps, span

#: Legal forms without and with dots, and words that name organisations (fixed values).
FORMS = (("SA", "S.A."), ("SRL", "S.R.L."), ("SAS", "S.A.S."), ("SACI", "S.A.C.I."), ("SACIF", "S.A.C.I.F."), ("SC", "S.C."), ("SH", "S.H."), ("SE", "S.E."))
ORGANISATIONS = (
    "COOPERATIVA", "MUNICIPALIDAD", "GOBIERNO", "PROVINCIA", "ESTADO", "BANCO", "EMPRESA", "ASOCIACIÓN", "ASOCIACION", "FUNDACIÓN", "FUNDACION", "MUTUAL", "SINDICATO", "FEDERACIÓN",
    "FEDERACION", "MINISTERIO",
)
#: Words that entity recognisers take for persons (fixed values, without accents).
NOT_PERSONS = tuple(
    """sr sra srta dr dra lic ing prof sres sras senor senora don dona juez jueza jueces juezas fiscal fiscales defensor defensora secretario secretaria secretarios secretarias actuario actuaria
    ministro ministra ministros ministras presidente presidenta vocal vocales camarista camaristas camara cam sala juzgado tribunal corte primero segundo tercero cuarto quinto sexto septimo octavo
    noveno decimo ordinario ordinaria extraordinario considerando vistos autos resulta resultando confluye brevitatis causa fojas foja res ll ja ed lll""".split()
)
STRINGS = "array<string>"


def _strings() -> Column:
    return F.expr(f"cast(array() as {STRINGS})")


def is_company(name: Column) -> Column:
    """A legal form among the words, dots aside, or a word that names organisations."""
    upper = F.upper(name)
    tokens = F.regexp_extract_all(F.replace(upper, F.lit(".")), F.lit(r"(?U)\w+"), F.lit(0))
    word = "|".join(ORGANISATIONS)
    return F.arrays_overlap(tokens, F.array(*[F.lit(a) for a, _ in FORMS])) | upper.rlike(rf"(?U)\b(?:{word})\b")


def _letters(x: Column) -> Column:
    return F.concat(F.array_join(F.transform(words(x), lambda w: F.upper(F.substring(w, 1, 1))), ". "), F.lit("."))


def initials(name: Column) -> Column:
    """SURNAME, NAMES -> S., N.; Name Surname -> N. S.; a company keeps its legal form, which must stand apart from the name."""
    forms = "|".join(sorted((d.replace(".", r"\.") + "|" + s for s, d in FORMS), key=len, reverse=True))

    def of(x: Column) -> Column:
        n, form = x["n"], x["form"]
        dotted = F.concat(F.regexp_replace(F.replace(form, F.lit(".")), r"(.)", "$1."))
        base = F.trim(F.substring(n, F.lit(1), F.length(n) - F.length(form)))
        surname, given = F.trim(F.substring_index(n, ",", 1)), F.trim(F.regexp_replace(n, r"^[^,]*,", ""))
        person = F.when(~F.contains(n, F.lit(",")), _letters(n)).when(given == "", _letters(surname)).otherwise(F.concat(_letters(surname), F.lit(", "), _letters(given)))
        return F.when(n == "", n).when(form == "", person).when(base == "", n).otherwise(F.concat(_letters(base), F.lit(" "), dotted))

    return let(F.trim(name), lambda n: let(F.struct(n.alias("n"), F.regexp_extract(F.upper(n), rf"(?:^|[ ,.;])({forms})$", 1).alias("form")), of))


def split_name(name: Column) -> Column:
    """struct<surname, given>: at the comma, else the last word is the surname."""
    n = squash(name)
    ws = words(n)
    comma = F.struct(squash(F.substring_index(n, ",", 1)).alias("surname"), squash(F.regexp_replace(n, r"^[^,]*,", "")).alias("given"))
    plain = F.struct(F.element_at(ws, -1).alias("surname"), F.array_join(F.slice(ws, 1, F.size(ws) - 1), " ").alias("given"))
    return F.when(F.contains(n, F.lit(",")), comma).when(F.size(ws) >= 2, plain).otherwise(F.struct(n.alias("surname"), F.lit("").alias("given")))


def _readings(n: Column) -> Column:
    """(surname, given) under every reading of the order of the parts."""
    ws = words(n)
    first = F.struct(F.element_at(ws, 1).alias("surname"), F.array_join(F.slice(ws, 2, F.size(ws)), " ").alias("given"))
    last = split_name(n)
    return F.when(F.contains(n, F.lit(",")), F.array(last)).when(F.element_at(ws, 1) == F.element_at(ws, -1), F.array(first)).otherwise(F.array(first, last))


def _with_forms(short: str, dotted: str):
    return lambda base: F.array(F.concat(base, F.lit(f" {short}")), F.concat(base, F.lit(f" {dotted}")))


def _styles(forms: Column) -> Column:
    """Every form as it is, in capitals and with capital initials."""
    return F.flatten(F.transform(forms, lambda x: F.array(x, F.upper(x), title_case(x))))


def _company_forms(n: Column) -> Column:
    """A name that ends with a legal form, with both spellings of it; none for other names."""
    forms = sorted(((form, short, dotted) for short, dotted in FORMS for form in (short, dotted)), key=lambda x: -len(x[0]))
    table = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(s).alias("short"), F.lit(d).alias("dotted")) for f, s, d in forms])
    ends = F.filter(table, lambda f: F.endswith(F.upper(n), f["form"]) & F.translate(F.substring(n, F.length(n) - F.length(f["form"]), F.lit(1)), " ,.;", "").isin("") & (F.length(n) > F.length(f["form"])))

    def of(f: Column) -> Column:
        base = F.regexp_replace(F.substring(n, F.lit(1), F.length(n) - F.length(f["form"])), r"[ ,.;]+$", "")
        return F.when(base != "", F.flatten(F.transform(_styles(F.array(base)), lambda b: F.array(F.concat_ws(" ", b, f["short"]), F.concat_ws(" ", b, f["dotted"])))))

    return F.coalesce(let(F.try_element_at(ends, F.lit(1)), lambda f: F.when(f.isNotNull(), of(f))), _strings())


def variants(name: Column) -> Column:
    """Full forms of a name in a stable order, never a surname alone: parts in both orders, short given names, three styles of
    capitals, forms without accents; for a company both spellings of its legal form."""
    long = lambda v: F.length(v) > 3

    def person(n: Column) -> Column:
        comma = F.contains(n, F.lit(","))

        def of(r: Column) -> Column:
            s, g = r["surname"], r["given"]
            with_comma = F.when(comma, F.array(F.concat_ws(", ", s, g))).otherwise(_strings())
            brief = let(words(g), lambda gs: F.when(F.size(gs) > 1, F.array(F.concat_ws(" ", gs[0], s), F.concat_ws(" ", s, gs[0]))).otherwise(_strings()))
            return _styles(F.concat(with_comma, F.array(F.concat_ws(" ", s, g), F.concat_ws(" ", g, s)), brief))

        def both(readings: Column) -> Column:
            alone = F.when(comma, F.element_at(readings, 1)["given"] == "").otherwise(F.size(words(n)) < 2)
            forms = F.array_distinct(F.filter(F.transform(F.concat(F.array(n), F.flatten(F.transform(readings, of))), squash), long))
            plain = let(forms, lambda fs: F.array_distinct(F.concat(fs, F.filter(F.transform(fs, fold_accents), long))))
            return F.when(alone, F.array(n)).otherwise(plain)

        return let(_readings(n), both)

    def of_name(n: Column) -> Column:
        return F.when(n == "", _strings()).otherwise(let(_company_forms(n), lambda c: F.when(F.size(c) > 0, F.array_distinct(F.filter(c, long))).otherwise(person(n))))

    return let(F.coalesce(squash(name), F.lit("")), of_name)


#: A letter with its accents, and any vowel (fixed values).
_CLASS = {"a": "[aáàâä]", "e": "[eéèêë]", "i": "[iíìîï]", "o": "[oóòôö]", "u": "[uúùûü]", "n": "[nñ]"}
_VOWEL = "[aeiouáéíóúàèìòùâêîôûäëïöü]"


def _char(c: Column, loose: Column) -> Column:
    def of(base: Column) -> Column:
        tight = F.element_at(F.create_map(*[F.lit(x) for kv in _CLASS.items() for x in kv]), base)
        return F.when(base.isin("a", "e", "i", "o", "u") & loose, F.lit(_VOWEL)).otherwise(F.coalesce(tight, F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))))

    return let(F.lower(fold_accents(c)), of)


def _pattern(word: Column, loose: bool) -> Column:
    """Pattern of a word: letters with or without accents; ``loose`` also lets inner vowels of words of four letters or more vary."""
    n = F.length(word)
    chars = F.transform(F.split(word, ""), lambda c, i: _char(c, F.lit(loose) & (n >= 4) & (i > 0) & (i < n - 1)))
    return F.array_join(chars, "")


def flexible(variant: Column) -> Column:
    """Pattern of a variant: any blanks between words, accents and inner vowels vary, an s may end a longer word, blanks may precede
    closing marks."""

    def one(w: Column) -> Column:
        tail = F.regexp_extract(w, r"[,.;:]*$", 0)
        core = F.substring(w, F.lit(1), F.length(w) - F.length(tail))
        long = F.length(core) > 3
        body = F.when(long & (F.lower(F.right(core, F.lit(1))) == "s"), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core)
        mark = F.when(tail != "", F.concat(F.lit(r"\s*\Q"), tail, F.lit(r"\E"))).otherwise(F.lit(""))
        return F.concat(F.when(body == "", F.lit("")).otherwise(_pattern(body, True)), F.when(long, F.lit("s?")).otherwise(F.lit("")), mark)

    return F.concat(F.lit(UNICODE_I), F.array_join(F.transform(words(variant), one), r"\s+"))


#: Links inside a name, most words between first name and surname, least length of either and of the whole.
LINKS = ("de", "del", "la", "las", "los", "y", "e")
BETWEEN, LEAST_PART, LEAST_FORM = 4, 3, 6


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"(?U)^[^\w]+|[^\w]+$", "")


def _unmarked(word: Column) -> Column:
    return F.regexp_replace(word, r"(?U)[^\w]+$", "")


def _same_key(word: Column) -> Column:
    """What two spellings of a word share: case and accents aside."""
    return F.lower(fold_accents(word))


def keyed(text: Column) -> Column:
    """struct<words, keys> of a text: its words, and what each begins with, opening marks, case and accents aside."""
    flat = _same_key(F.regexp_replace(squash(text), r"(?U)(?<![^ ])[^\w ]+(?=\w)", ""))
    return F.struct(words(text).alias("words"), F.split(flat, " ").alias("keys"))


def longer_forms(name: Column, text: Column, tokens: Column | None = None) -> Column:
    """Longer forms of a name in the text: first name, one to four capitalised or linking words, surname; longest first.

    The words of the text (``tokens``: its ``keyed``, worked out by the caller where many names meet one text) are looked up by key; from
    every place of the first name the surname is sought among the words behind it.
    """
    n = squash(name)
    tokens = keyed(text) if tokens is None else tokens
    ws, keys = tokens["words"], tokens["keys"]

    def of(r: Column) -> Column:
        given = F.filter(F.transform(words(r["given"]), lambda w: F.regexp_replace(w, r"\.+$", "")), lambda w: F.length(w) >= LEAST_PART)
        first, surname = _same_key(F.try_element_at(given, F.lit(1))), _unmarked(_same_key(r["surname"]))
        size = F.size(words(r["surname"]))

        def ends_at(i: Column, k: int) -> Column:
            """The form from word i on with k words between, null if there is none."""
            last = _unmarked(_same_key(F.array_join(F.slice(ws, i + 2 + k, size), " ")))
            named = F.forall(F.slice(ws, i + 2, F.lit(k)), lambda w: w.isin(*LINKS) | w.rlike(r"^[A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ.]{1,24}$"))
            return F.when((last == surname) & named, F.array_join(F.slice(ws, i + 1, k + 1 + size), " "))

        starts = F.filter(F.transform(keys, lambda key, i: F.struct(key.alias("f"), i.alias("i"))), lambda x: x["f"] == first)
        forms = F.flatten(F.transform(starts, lambda x: F.array(*[ends_at(x["i"], k) for k in range(BETWEEN, 0, -1)])))
        return F.when(first.isNotNull() & (F.length(r["surname"]) >= LEAST_PART), F.transform(F.filter(forms, lambda v: v.isNotNull()), _bare)).otherwise(_strings())

    has = F.contains(n, F.lit(",")) | (F.size(words(n)) >= 2)
    found = F.array_distinct(F.flatten(F.transform(_readings(n), of)))
    found = F.filter(found, lambda v: (F.lower(v) != F.lower(n)) & (F.length(v) >= LEAST_FORM))
    ordered = F.transform(F.array_sort(F.transform(found, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    return F.when(has, ordered).otherwise(_strings())


def bones(x: Column) -> Column:
    """What a form and every text that its tolerant pattern matches have in common: consonants but s, digits and marks, in order."""
    return F.regexp_replace(F.lower(fold_accents(x)), r"(?U)[aeiousſ\s]+", "")


def name_spans(text: Column, forms: Column, placeholder: Column | None = None, party: Column | None = None, role: Column | None = None, held: Column | None = None) -> Column:
    """Disjoint occurrences of any of the forms; of overlapping ones the longer stays. ``held``: ``bones`` of the text, worked out once;
    a form whose own bones they do not hold cannot match, and its pattern is not tried."""

    # the pattern of a form also matches the form itself, and forms that differ in capitals or accents share one pattern
    usable = F.filter(forms, lambda v: F.length(v) >= 4)
    distinct = F.array_distinct(F.transform(usable, lambda v: F.lower(fold_accents(v))))
    if held is not None:
        distinct = F.filter(distinct, lambda v: F.contains(held, bones(v)))
    patterns = F.array_distinct(F.transform(distinct, flexible))
    found = F.flatten(F.transform(patterns, lambda p: find_free(text, p)))
    hits = F.array_distinct(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"))))
    extra = {k: v for k, v in (("placeholder", placeholder), ("party_name", party), ("party_rol", role)) if v is not None}
    made = F.transform(hits, lambda m: span(start=m["start"], end=m["end"], text=m["text"], type=F.lit("PER"), source=F.lit("text_search"), confidence=F.lit(0.99), **extra))
    return F.when(F.coalesce(text, F.lit("")) == "", no_spans()).otherwise(resolve_overlaps(made, by_priority=False))


def collapse_doubles(x: Column) -> Column:
    return F.regexp_replace(x, r"(?i)([bcdfghjklmnpqrstvwxz])\1", "$1")


def prepared(text: Column) -> Column:
    """What names are checked against, worked out once for a text: its plain, small and accent-free forms and the keys of its words."""
    t = squash(text)
    have = F.filter(F.regexp_extract_all(t, F.lit("[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    pairs = F.transform(F.array_distinct(have), lambda w: F.struct(_key(w).alias("k"), w.alias("w")))
    return F.struct(t.alias("plain"), F.lower(t).alias("low"), fold_accents(F.lower(t)).alias("flat"), pairs.alias("words"))


def _key(word: Column) -> Column:
    return collapse_doubles(fold_accents(F.lower(word)))


def corrected(name: Column, ready: Column) -> Column:
    """The name with words respelled as the text has them where only doubled consonants and accents differ; null if none differs."""

    def fixed(w: Column) -> Column:
        first = let(_key(w), lambda k: F.try_element_at(F.filter(ready["words"], lambda p: p["k"] == k), F.lit(1))["w"])
        return let(first, lambda x: F.when(x.isNotNull() & (F.lower(x) != F.lower(w)), x).otherwise(w))

    def parts(n: Column) -> Column:
        comma = F.contains(n, F.lit(","))
        return F.transform(F.when(comma, F.array(F.substring_index(n, ",", 1), F.regexp_replace(n, r"^[^,]*,", ""))).otherwise(F.array(n)), squash)

    def of(ps: Column) -> Column:
        out = F.array_join(F.transform(ps, lambda x: F.array_join(F.transform(words(x), fixed), " ")), ", ")
        return let(out, lambda x: F.when(x != F.array_join(ps, ", "), x))

    return let(squash(name), lambda n: let(parts(n), of))


def validated(name: Column, ready: Column) -> Column:
    """The name as it may be used: unchanged if the text holds it in some order, case or without accents; respelled if only
    doubled consonants differ; null if it is too short, a company, or not in the text. ``ready`` is ``prepared(text)``."""

    def of(n: Column, ws: Column) -> Column:
        inverted = F.concat_ws(" ", F.trim(F.regexp_replace(n, r"^[^,]*,", "")), F.trim(F.substring_index(n, ",", 1)))
        turns = F.array(F.concat_ws(" ", F.array_join(F.slice(ws, 2, F.size(ws)), " "), F.element_at(ws, 1)), F.concat_ws(" ", F.element_at(ws, -1), F.array_join(F.slice(ws, 1, F.size(ws) - 1), " ")))
        forms = F.when(F.contains(n, F.lit(",")), F.array(n, inverted)).when(F.size(ws) >= 2, F.concat(F.array(n), turns)).otherwise(F.array(n))
        held = F.exists(forms, lambda c: F.contains(ready["plain"], c) | F.contains(ready["low"], F.lower(c)) | F.contains(ready["flat"], fold_accents(F.lower(c))))
        return F.when(held, name).otherwise(corrected(n, ready))

    usable = name.isNotNull() & (F.length(name) >= 3) & ~is_company(name)
    return F.when(usable, let(squash(name), lambda n: let(words(n), lambda ws: of(n, ws))))


def without_junk(name: Column) -> Column:
    """An entity without what recognisers glue to its end: separators of parties, "y otros", marks; repeated until nothing changes."""
    step = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?iU)\s+(?:[csyeo]/?|c\.|s\.|y\s+otros?|y\s+otra)\s*$", ""), r"[ ,.;:]+$", "")
    rounds = F.sequence(F.lit(1), F.size(F.split(name, r"(?U)\s+")) + 1)
    return F.when(name.isNotNull(), F.aggregate(rounds, name, lambda acc, _: step(acc)))


def is_person(entity: Column) -> Column:
    """False for words that recognisers mistake for persons."""
    key = F.trim(F.lower(F.regexp_replace(fold_accents(entity), r"(?U)[^\w\s]", "")))
    return ~key.isin(*NOT_PERSONS)
