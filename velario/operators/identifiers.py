"""Detectors of structured identifiers: a registry of name -> (text column -> array of spans).

All detectors of a row read the text in one projection; a cheap literal test spares texts that cannot match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions.checks import cbu_ok, cuit_ok
from velario.functions.text import MATCH, UNICODE, UNICODE_I, digits, find_all
from velario.operators.spans import no_spans, resolve_overlaps, span

NUMBER_SIGN = r"[\s:N°º.]*"
DNI_WORDS = r"(?:DNI|D\.N\.I\.?|D\. ?N\. ?I\.?|L\.?E\.?|L\.?C\.?|documento(?:\s+de\s+identidad)?)"
DNI = UNICODE_I + DNI_WORDS + NUMBER_SIGN + r"(\d{1,2}\.?\d{3}\.?\d{3})\b"
#: The same with a boundary before the word, for callers that do not want "calle 1234567".
DNI_STRICT = UNICODE_I + r"(?<!\w)" + DNI_WORDS + NUMBER_SIGN + r"(\d{1,2}\.?\d{3}\.?\d{3})\b"
CUIT = UNICODE + r"\b\d{2}[-\s]?\d{8}[-\s]?\d\b"
CBU = UNICODE + r"\b\d{22}\b"
EMAIL = UNICODE + r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = UNICODE_I + r"(?:tel[eé]fono|tel\.?|celular|cel\.?|m[oó]vil|fax)" + NUMBER_SIGN + r"((?:\+?54[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)?\d{3,4}[\s\-]?\d{4})"
PLATE_NEW = UNICODE + r"\b[A-Z]{2}\s*\d{3}\s*[A-Z]{2}\b"
PLATE_OLD = UNICODE + r"\b[A-Z]{3}\s*\d{3}\b"
PASSPORT = UNICODE_I + r"pasaporte" + NUMBER_SIGN + r"([A-Z]{1,3}\s?\d{6,8})\b"


def _made(matches: Column, kind: str, confidence: float, group: bool = False, keep: Callable[[Column], Column] | None = None, **extra) -> Column:
    """Spans of matches; with ``group`` the span is the captured end of the match."""
    if keep is not None:
        matches = F.filter(matches, keep)

    def one(m: Column) -> Column:
        text = m["group"] if group else m["text"]
        fields = {k: v(m) if callable(v) else v for k, v in extra.items()}
        return span(start=m["end"] - F.length(text), end=m["end"], text=text, type=F.lit(kind), source=F.lit("regex"), confidence=F.lit(confidence), **fields)

    return F.transform(matches, one)


def dni(text: Column, strict: bool = False) -> Column:
    plain = lambda m: F.replace(m["group"], F.lit("."))
    keep = lambda m: plain(m).rlike(r"^\d{7,8}$") & plain(m).try_cast("bigint").between(1_000_000, 99_999_999)
    return _made(find_all(text, DNI_STRICT if strict else DNI, 1), "DNI", 1.0, True, keep, normalized=plain)


def cuit(text: Column) -> Column:
    return _made(find_all(text, CUIT), "CUIT", 1.0, keep=lambda m: cuit_ok(digits(m["text"])), normalized=lambda m: digits(m["text"]))


def cbu(text: Column) -> Column:
    return _made(find_all(text, CBU), "CBU", 1.0, keep=lambda m: cbu_ok(m["text"]), normalized=lambda m: m["text"])


def email(text: Column) -> Column:
    found = F.when(F.contains(text, F.lit("@")), find_all(text, EMAIL)).otherwise(F.expr(f"cast(array() as {MATCH})"))
    return _made(found, "EMAIL", 1.0)


def phone(text: Column) -> Column:
    keep = lambda m: F.length(digits(m["group"])).between(6, 14)
    return _made(find_all(text, PHONE, 1), "TELEFONO", 0.95, True, keep, normalized=lambda m: digits(m["group"]))


def plate(text: Column) -> Column:
    """Vehicle plates; an old-form match that begins inside a new-form one is not a plate (an interval anti join in the row)."""
    new, old = find_all(text, PLATE_NEW), find_all(text, PLATE_OLD)
    alone = F.filter(old, lambda o: ~F.exists(new, lambda n: (n["start"] <= o["start"]) & (o["start"] < n["end"])))
    return F.concat(_made(new, "PATENTE", 0.9, formato=F.lit("mercosur")), _made(alone, "PATENTE", 0.75, formato=F.lit("viejo")))


def passport(text: Column) -> Column:
    return _made(find_all(text, PASSPORT, 1), "PASAPORTE", 0.9, True)


#: The order decides ties of equal spans. Add a detector here to extend the engine.
DETECTORS: dict[str, Callable[[Column], Column]] = {"dni": dni, "cuit": cuit, "cbu": cbu, "email": email, "phone": phone, "plate": plate, "passport": passport}


def identifiers(text: Column, detectors: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """Disjoint spans of all detectors."""
    found = [d(text) for d in (detectors or DETECTORS).values()]
    return F.when(text.isNull(), no_spans()).otherwise(resolve_overlaps(F.concat(*found)))
