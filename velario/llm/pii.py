"""Problem 2: personal information inside free text, replaced by typed placeholders.

E-mail addresses, telephones, identity numbers and street addresses are found by their forms and the words around them in a
clean view of the text; names by the conditional random field of ``persons``. Offsets are those of the stored text.

Defined results: null and empty texts hold nothing and stay as they are; of overlapping finds the one of the stronger kind
stays (e-mail, identity number, telephone, address, name); repeated rows give the same finds once; judges, cited authors,
organisations, towns, dockets, folio, page and law numbers, dates and amounts are never finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import persons
from .cleanview import view
from .common import arrow_rows, spread

AT_SIGN = re.compile(r"@|[(\[]\s?(?:at|arroba)\s?[)\]]|(?<=\s)arroba(?=\s)")
MAILBOX = re.compile(r"[A-Za-z0-9._%+\-]")
DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:(?:\.|\(dot\)|\[punto\])[A-Za-z0-9\-]+)*(?:\.|\[punto\])[A-Za-z]{2,}(?![A-Za-z0-9])")
S = r"[\s.\-]?"
#: Numbers with their words; the find is group 1.
ID_FORMS = (
    re.compile(r"(?<![\w.\-/])(\d{22})(?![\w])"),
    re.compile(r"(?:C\.?\s?U\.?\s?[I1l]\.?\s?[TL]\.?)[\s:N°º.]*((?:20|2[3-7]|3[034])[\s\-.]?\d{1,2}\.?\d{3}\.?\d{3}[\s\-.]?\d)(?!\d)", re.I),
    re.compile(r"(?<![\w.\-/])((?:20|2[3-7]|3[034])[\s\-]\d{8}[\s\-]\d)(?![\w\-/])"),
    re.compile(r"C\.?\s?B\.?\s?U\.?[\s:N°º.]*((?:\d[\s\-.]?){21}\d)(?!\d)", re.I),
    re.compile(r"(?:\bD\.?\s?N\.?\s?[I1l]\.?|\bL\.?\s?[EC]\.?|\bdocumento(?:\s+(?:nacional\s+)?de\s+identidad)?|\bidentidad)(?:\s*(?:N[°º.]|nro\.?|n[uú]mero|núm\.?|[:°º]))*\s*(\d{1,2}[.\s]?\d{3}[.\s]?\d{3})(?![\d])", re.I),
    re.compile(r"[A-Za-zÁÉÍÓÚÑáéíóúñ�]\s+-\s+(\d{1,2}[.\s]?\d{3}[.\s]?\d{3})(?=\s+-\s)"),  # name - number - telephone
    re.compile(r"pasaporte(?:\s*(?:N[°º.]|nro\.?|n[uú]mero|:))*\s*([A-Z]{1,3}\s?\d{6,8})(?!\d)", re.I),
)
PHONE_CUE = r"(?:tel[eé]fonos?|t[eé]l\s?\.?|cel\s?\.?|celular(?:es)?|m[oó]vil|fax|whats?app|llamar(?:\s+al?)?|n[uú]mero|proven[ií]an\s+del|comunicarse(?:\s+al)?)"
PHONE_BODY = r"(?:\+?\s?54[\s\-]?(?:9[\s\-]?)?)?(?:\(0?\d{2,4}\)[\s\-]?|0?\d{2,4}[\s\-])?(?:15[\s\-]?)?\d{2,4}[\s\-]?\d{4}"
PHONE_FORMS = (
    re.compile(r"(?<![\w+./\-])(\+\s?54[\s\-]?(?:9[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4})(?![\w/])"),
    re.compile(r"(?<![\w./\-])(\(0\d{2,4}\)[\s\-]?(?:15[\s\-]?)?\d{3,4}[\s\-]?\d{3,4})(?![\w/])"),
    re.compile(r"(?<![\w./\-])(0\d{2,4}[\s\-](?:15[\s\-]?)?\d{3,4}[\s\-]?\d{3,4})(?![\w/])"),
    re.compile(r"(?<![\w./\-$,])(?<!\$\s)(\d{3,4}\s\d{3}\s\d{4})(?![\w/\-]|[.,]\d)"),
    re.compile(r"\d\s+-\s+(\d{10})(?=\s+-\s)"),
    re.compile(rf"{PHONE_CUE}[\s.:N°º]*(?:es\s+|al?\s+|el\s+|n[uú]mero\s+|n[°º]\s*)*({PHONE_BODY}|\d{{6,11}})(?![\w/])", re.I),
)
STREET = r"(?:Avenida|Avda?\.?|Av\.?|Bv\.?|Bvd\.?|Blvd\.?|Bulevar|Boulevard|Calle|Pasaje|Pje\.?|Diagonal|Diag\.?|Camino|Ruta|C/)"
NAME_WORD = r"(?:[A-ZÁÉÍÓÚÑ][\wáéíóúñÁÉÍÓÚÑ.�]*|\d{1,2}\s+de\s+[A-Z]\w+)"
STREET_NAME = rf"(?:(?:de|del|la|las|los|el)\s+)*{NAME_WORD}(?:\s+(?:(?:de|del|la|las|los|el|y)\s+)*{NAME_WORD}){{0,4}}"
HOUSE = r"\s*,?\s*(?:(?:N\s?[°º]|nro\.?|n[uú]m\.?|N\.?[°º])\s*)?(?:\d{1,5}(?![\d.,]*\d)|s\s?/\s?n(?:\s*,\s*casa\s+\d+)?)"
ADDRESS_FORMS = (
    re.compile(rf"(?<![\w])({STREET})\s*{STREET_NAME}{HOUSE}"),
    re.compile(rf"(?<![\w])((?:calle|pasaje|avenida|bulevar|diagonal|camino|av\.|bv\.|pje\.|c/))\s*{STREET_NAME}{HOUSE}"),
    re.compile(rf"(?:domicilio(?:\s+\w+)?\s+(?:en|:)|domiciliad[oa]\s+en|reside\s+en|vivido\s+en|vive\s+en|inmueble\s+de|mudó\s+de)\s*:?\s*({STREET_NAME}{HOUSE})"),
)
#: REACH is more than the longest word or phrase before a number has.
FIGURES, REACH = re.compile(r"\d[\d\s.\-()+]{4,}\d"), 60
PLACEHOLDERS = {"email": "EMAIL", "phone": "TELEFONO", "id_number": "DOCUMENTO", "address": "DOMICILIO", "name": "PERSONA"}


def structured(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) in the clean view, disjoint."""
    found: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for _, x, y in found)

    for m in AT_SIGN.finditer(text):  # from the sign outwards: no search at every word
        word = m.group() != "@"  # a sign in words may have blanks around it
        a = m.start() - (word and text[m.start() - 1 : m.start()].isspace())
        b = m.end() + (word and text[m.end() : m.end() + 1].isspace())
        start, domain = a, DOMAIN.match(text, b)
        while start and MAILBOX.match(text[start - 1]):
            start -= 1
        while start < a and not text[start].isalnum():
            start += 1
        if start < a and domain:
            found.append(("email", start, domain.end()))
    near: list[list[int]] = []  # the surroundings of figures, where alone numbers can be
    for m in FIGURES.finditer(text):
        a = m.start()
        while a and text[a - 1] in " \t\n:N°º.":  # what may part a word and its number, however much of it
            a -= 1
        if near and a - REACH <= near[-1][1]:
            near[-1][1] = m.end() + 4
        else:
            near.append([max(0, a - REACH), m.end() + 4])
    whole = [[0, len(text)]]
    for kind, forms in (("id_number", ID_FORMS), ("phone", PHONE_FORMS), ("address", ADDRESS_FORMS)):
        for form in forms:
            for m in (m for lo, hi in (whole if kind == "address" else near) for m in form.finditer(text, lo, hi)):
                a, b = m.span(1) if kind != "address" else (m.start(1), m.end())
                if kind == "phone" and not 6 <= sum(c.isdigit() for c in text[a:b]) <= 14:
                    continue
                if free(a, b):
                    found.append((kind, a, b))
    return sorted(found, key=lambda x: x[1])


def found_in(texts: list[tuple[str, bool]], model: persons.Model) -> list[list[tuple[str, int, int]]]:
    """Finds (type, start, end) in stored offsets, of each (text, has pages); names of a batch are decided in one graph."""
    views = [view(t, pages) if t else ("", []) for t, pages in texts]
    fixed = [structured(v) for v, _ in views]
    named = persons.names([v for v, _ in views], fixed, model)
    out = []
    for (v, at), a, b in zip(views, fixed, named, strict=True):
        items = sorted([*a, *(("name", s, e) for s, e in b)], key=lambda x: x[1])
        out.append([(kind, at[s], at[e - 1] + 1) for kind, s, e in items])
    return out


def redact(text: str | None, items: list[tuple[str, int, int]]) -> str | None:
    """The text with a typed and, within the text, numbered placeholder for every find."""
    if not text:
        return text
    out, at, seen = [], 0, {}
    for kind, a, b in items:
        value = re.sub(r"\W+", "", text[a:b].lower())
        number = seen.setdefault(kind, {}).setdefault(value, len(seen[kind]) + 1)
        out += [text[at:a], f"[{PLACEHOLDERS[kind]}_{number}]"]
        at = b
    return "".join([*out, text[at:]])


def documents(pdf: DataFrame, docx: DataFrame) -> DataFrame:
    """doc_kind, doc_id, text of both tables."""
    a = pdf.select(F.lit("pdf").alias("doc_kind"), "doc_id", F.col("full_text").alias("text"))
    return spread(a, "doc_id").unionAll(spread(docx.select(F.lit("docx").alias("doc_kind"), "doc_id", F.col("full_text").alias("text")), "doc_id"))


def finds(docs: DataFrame, model: persons.Model | None = None) -> DataFrame:
    """doc_kind, doc_id, pii_type, char_start, char_end of every occurrence."""
    held = docs.sparkSession.sparkContext.broadcast(model or persons.Model.load())

    def run(rows) -> Iterator[tuple]:
        rows = [r for r in rows if r[2]]
        for (kind, i, _), items in zip(rows, found_in([(t, k == "pdf") for k, _, t in rows], held.value), strict=True):
            for pii, a, b in items:
                yield kind, i, pii, a, b

    return arrow_rows(docs.select("doc_kind", "doc_id", "text"), "doc_kind string, doc_id bigint, pii_type string, char_start int, char_end int", run, 64)


def redacted(docs: DataFrame, model: persons.Model | None = None) -> DataFrame:
    """doc_kind, doc_id, redacted of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model or persons.Model.load())

    def run(rows) -> Iterator[tuple]:
        rows = list(rows)
        for (kind, i, t), items in zip(rows, found_in([(t, k == "pdf") for k, _, t in rows], held.value), strict=True):
            yield kind, i, redact(t, items)

    return arrow_rows(docs.select("doc_kind", "doc_id", "text"), "doc_kind string, doc_id bigint, redacted string", run, 64)
