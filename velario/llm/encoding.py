"""Problem 3: text decoded with the wrong character encoding.

Method: the garbled sequences of all encoding pairs are computed beforehand from the codecs and matched with a multi-pattern
automaton; only matched spans are replaced, so that correct text around them stays. Sequences of several characters (UTF-8 read
as a one-byte encoding, any number of times) stand for themselves; where the reader was made for another script or language they
count only beside a Latin letter. They are undone round by round until none is left, and every round shortens the text. Only then
are single garbled characters looked at (one one-byte encoding read as another): they also exist in correct text, so each counts
only where correct text cannot hold it: inside a word as a symbol, as a letter of the wrong case, or where only the restored word is known.

Defined results: null and empty texts are never damaged; U+FFFD is damage that is restored only where one known word fits, else it stays;
foreign words and free-standing symbols stay; repeated rows give one row.
"""

from __future__ import annotations

from functools import cache, lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARE, arrow_rows, spread

ONE_BYTE = ("cp1252", "cp850", "cp437", "mac_roman")
#: Readers made for other languages: their garbled sequences are letters of those.
LATIN_READERS, CYRILLIC_READERS = ("cp1250", "cp1254", "iso8859_2", "iso8859_15"), ("cp1251", "koi8_r")
#: Letters and marks of Spanish and its neighbours that a damaged ruling may have held (fixed values).
LETTERS = "áéíóúüñÁÉÍÓÚÜÑãõâêôàèìòùçäëïöÃÕÂÊÔÀÈÇÄËÏÖß"
MARKS = "¡¿ºª°«»·×Ø§£€–—‘’“”…†•"
#: Characters outside ordinary Spanish text, which JVM and Python look at first.
SUSPECT = r"[^\x00-\x7FáéíóúñüÁÉÍÓÚÑÜ°º]"
#: Accented letters of the wrong case: a row with neither these nor SUSPECT characters cannot be damaged.
WRONG_CASE = "(?<=[a-záéíóúñü][ÁÉÍÓÚÑÜ])|(?<=[A-ZÁÉÍÓÚÑÜ][áéíóúñü])(?=[A-ZÁÉÍÓÚÑÜ])|(?<=[A-ZÁÉÍÓÚÑÜ]{2}[áéíóúñü])(?![a-záéíóúñü])"
#: Either, tried only after a character outside ASCII, so that plain rows are read once.
GATE = rf"[^\x00-\x7F](?:(?<={SUSPECT})|{WRONG_CASE})"


def _read(raw: bytes, encoding: str) -> str:
    """Decode as lenient readers do: bytes that an encoding leaves open become C1 controls."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)


@cache
def sequences() -> ahocorasick.Automaton:
    """Garbled sequence -> (length, original, sure, beside a Latin letter only), of all characters that take several bytes, for every
    one-byte reader. Where two readers give one sequence, the first stands."""
    latin = [*range(0x80, 0x180), 0x20AC, 0x2122, *range(0x2010, 0x2045)]
    every = [*latin, *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x2200, 0x2600), *range(0x3001, 0x3100), *range(0x4E00, 0xA000), *range(0xFF01, 0xFF61), *range(0xFB00, 0xFB03)]
    # what a reader can make of a byte may be garbled a second time
    made = [ord(_read(bytes([b]), e)) for e in (*ONE_BYTE, *LATIN_READERS) for b in range(0x80, 0x100)]
    a = ahocorasick.Automaton()
    ours = [ord(c) for c in LETTERS]  # of Cyrillic readers only these: they all begin with a letter that is no Latin look-alike
    for readers, codes, beside in (((*ONE_BYTE, "latin-1"), [*every, *made], False), (LATIN_READERS, [*latin, *made], True), (CYRILLIC_READERS, ours, True)):
        for code in dict.fromkeys(codes):
            for encoding in readers:
                g = _read(chr(code).encode(), encoding)
                if g not in a:
                    sure = code < 0x180 or 0x2010 <= code < 0x2600 or code >= 0xFB00
                    a.add_word(g, (len(g), chr(code), sure, beside))
    a.make_automaton()
    return a


@cache
def singles() -> dict[str, frozenset[str]]:
    """Garbled character -> possible originals, of the pairs of one-byte encodings."""
    out: dict[str, set[str]] = {}
    for good in LETTERS[:14] + "ãõâêôàçÃÕÂÊÔÀÇ" + "ºª°":
        for a in ONE_BYTE:
            for b in ONE_BYTE:
                try:
                    g = _read(good.encode(a), b)
                except UnicodeEncodeError:
                    continue
                if g != good and not g.isascii():
                    out.setdefault(g, set()).add(good)
    return {k: frozenset(v) for k, v in out.items()}


#: Signs that stand alone in correct text, by what they turn into (fixed values).
ALONE = {"ž": "×", "◊": "×", "ÿ": "Ø", "œ": "£"}
CLOSING = set("”’…—–™®»¬")
NUMBER_MARKS = set("ø§∞∫™¯¼╝░║")
BOX = {chr(c) for c in range(0x2500, 0x25A0)}


def _pick(c: str, upper: bool, choices: frozenset[str]) -> str | None:
    fit = sorted(x for x in choices if x.isalpha() and x.isupper() == upper and x not in "ºª")
    return next((x for x in "áóíéúñÁÓÍÉÚÑüÜãçõâêôàÃÇÕÂÊÔÀ" if x in fit), None)


@lru_cache(8)
def longest(known: frozenset[str]) -> int:
    """Letters of the longest known word."""
    return max(map(len, known), default=0)


def _known(text: str, i: int, known: frozenset[str], choices: str) -> str | None:
    """The choice with which the word around place i is a known word, if any."""
    a, b, reach = i, i + 1, longest(known)  # further letters than any known word has decide nothing
    while a and i - a <= reach and text[a - 1].isalpha():
        a -= 1
    while b < len(text) and b - i <= reach and text[b].isalpha():
        b += 1
    capitals = text[a:i].isupper() and text[i + 1 : i + 2].isupper() or not text[a:i] and text[i + 1 : i + 3].isupper()
    for x in choices:
        if x.islower() and capitals or x.isupper() and text[a:i][-1:].islower():
            continue
        w = text[a:i] + x + text[i + 1 : b]
        if len(w) > 2 and (w in known or w.lower() in known or w.capitalize() in known):
            return x
    return None


def single(text: str, i: int, known: frozenset[str]) -> str | None:
    """The original of a garbled single character at place i, or None if it may be correct."""
    c = text[i]
    p, n = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
    nn = text[i + 2] if i + 2 < len(text) else " "
    if c == "\xa0":
        if not p.isalpha():
            return None
        a, reach = i, longest(known)
        while a and i - a <= reach and text[a - 1].isalpha():
            a -= 1
        left = text[a:i]
        b = i + 1
        while b < len(text) and b - i <= reach and text[b].isalpha():
            b += 1
        right = text[i + 1 : b]
        for w in (left + "á" + right,):
            if len(w) > 2 and (w in known or w.lower() in known) and not (left.lower() in known and (not right or right.lower() in known)):
                return "á"
        return None
    if c in ALONE and not p.isalnum() and not n.isalnum():
        return ALONE[c]
    if c == "ø" and n == "C" and not p.isalpha():
        return "°"
    choices = singles().get(c)
    if not choices:
        return None
    if c == "µ" and not p.isalpha() and n.isupper() and nn.isupper():
        return "Á"
    lower_before, upper_before = p.islower() and p not in "ºª", p.isupper()
    if c in NUMBER_MARKS and (p in "Nn" or p.isdigit() or (c == "∞" and n == "C")) and not n.isalpha():
        return "°" if "°" in choices else "º" if "º" in choices else "ª"
    if c == "∞" and n == "C":
        return "°"
    if c.isalpha() and c not in "ºªµ":
        if c in "øØ" or c in "áéíóúñüÁÉÍÓÚÑÜ" and not (c.islower() and upper_before and (n.isupper() or not n.isalpha() and text[i - 2 : i - 1].isupper())) and not (c.isupper() and lower_before):
            return None
        if c.isupper() and lower_before:
            return _pick(c, False, choices)
        if c.islower() and (upper_before and (n.isupper() or not n.isalpha()) and (i < 2 or not text[i - 2].islower()) and (n.isupper() or text[i - 2 : i - 1].isupper())):
            return _pick(c, True, choices)
        if c.isupper() and (upper_before or n.isupper()) and c in "ÕÖËÐÛÒÌÈÝÆ" and not text[i:].startswith(("ÕES", "ÕE")):
            if n.islower():
                return _pick(c, False, choices)
            return _pick(c, True, choices) or _pick(c, False, choices)
        if c in "ÈÌÒÛÚÝ" and n.islower() and not p.isalpha() and (x := _known(text, i, known, "".join(sorted(choices)))):
            return x
        return None
    if c in BOX:
        return (_pick(c, upper_before or n.isupper(), choices) or _pick(c, False, choices)) if p.isalpha() or n.isalpha() else None
    if c == "·" and p in "lL" and n in "lL":
        return _known(text, i, known, "áúÁÚ")
    if c in "°º³²¹ª" or c == "¬":
        return None
    if c in CLOSING or c in "“‘„":
        if upper_before and n.isupper():
            return _pick(c, True, choices)
        if p.isalpha() and n.islower() and c == "„":
            return _pick(c, False, choices)
        return _known(text, i, known, "ÉÑÓ") if upper_before and text[i - 2 : i - 1].isupper() else None
    if not p.isalnum() and n.isalpha() and c not in "“‘„«¿" and (x := _known(text, i, known, "".join(sorted(x for x in choices if x not in "ºª°")))):
        return x
    if c == "¡" and not p.isalpha():
        return "Á" if n.isupper() and nn.isupper() and nn not in "AEIOUÁÉÍÓÚ" and n not in "AEIOUÁÉÍÓÚ" and n + nn in ("NG", "LV", "RB", "MB", "ND", "NT", "VI") else None
    if c in "¶€‡" and p == '"':
        return _pick(c, n.isalpha(), choices)
    if p.isalpha() and (n.isalpha() or c not in "±"):
        upper = upper_before and (n.isupper() or not n.isalpha())
        return _pick(c, upper, choices) or _pick(c, not upper, choices)
    if n.isalpha() and c in "˙·¢¤‚£" and not p.isalnum() and (x := _known(text, i, known, "".join(sorted(choices)))):
        return x
    return "ú" if c == "˙" and n.isalpha() else None


def _beside_latin(text: str, a: int, b: int) -> bool:
    p, n = text[a - 1 : a], text[b : b + 1]
    return p.isascii() and p.isalpha() or n.isascii() and n.isalpha()


def garbled(text: str) -> list[tuple[int, int, str]]:
    """Spans of garbled sequences of several characters, longest first at each place, disjoint and in order."""
    found = [(end - size + 1, end + 1, good, sure, beside) for end, (size, good, sure, beside) in sequences().iter(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str, bool, bool]] = []
    for f in found:
        if (not kept or f[0] >= kept[-1][1]) and (not f[4] or _beside_latin(text, f[0], f[1]) or kept and kept[-1][1] == f[0]):
            kept.append(f)
    spans = []
    for k, f in enumerate(kept):  # letters of other scripts come in words
        near = any(0 <= k + d < len(kept) and (kept[k + d][0] == f[1] or kept[k + d][1] == f[0]) for d in (-1, 1))
        if f[3] or near or f[1] - f[0] > 2:
            spans.append(f[:3])
    return spans


def damage(text: str, known: frozenset[str] = frozenset()) -> list[tuple[int, int, str | None]]:
    """Damaged spans (start, end, original or None), disjoint and in order."""
    spans: list[tuple[int, int, str | None]] = list(garbled(text))
    taken = {i for a, b, _ in spans for i in range(a, b)}
    for i, c in enumerate(text):
        if c > "\x7f" and i not in taken:
            if c == "�" or "\x80" <= c <= "\x9f":
                good = None
                if c == "�":
                    good = _known(text, i, known, "óíáúéñÓÍÁÚÉÑ")
                else:
                    try:
                        good = c.encode("latin-1").decode("cp850")
                    except UnicodeError:
                        good = None
                spans.append((i, i + 1, good))
            elif (good := single(text, i, known)) is not None:
                spans.append((i, i + 1, good))
    return sorted(spans)


def next_repair(text: str, known: frozenset[str], last: bool = False) -> tuple[list[tuple[int, int, str]], bool]:
    """The spans to replace next, and whether they are the last: garbled sequences while there are any, then single characters once."""
    if last:
        return [], True
    if spans := garbled(text):
        return spans, False
    return [s for s in damage(text, known) if s[2] is not None], True


def restore(text: str, known: frozenset[str] = frozenset()) -> str:
    """The text with every restorable damaged span replaced; several wrong decodings are undone one after another, the outermost first.

    A sequence is always longer than what it restores, so the rounds end. If what remains looks more damaged than before, the text stays."""
    last, best, old = False, len(damage(text, known)), text
    while True:
        spans, last = next_repair(text, known, last)
        if not spans:
            return text if len(damage(text, known)) <= best else old
        out, at = [], 0
        for a, b, good in spans:
            out += [text[at:a], good]
            at = b
        text = "".join([*out, text[at:]])


def accented_words(texts: list[DataFrame], share: float = SHARE) -> frozenset[str]:
    """The ordinary accented words of all rows, counted by JVM expressions; at most 1 / ``share`` (a bounded broadcast)."""
    every = None
    for df in texts:
        part = df.where(F.col(df.columns[0]).rlike("[áéíóúñÁÉÍÓÚÑ]")).select(F.explode(F.regexp_extract_all(F.col(df.columns[0]), F.lit(r"(?<![^ \n])[a-zA-Z]*[áéíóúñÁÉÍÓÚÑ][a-zA-ZáéíóúñÁÉÍÓÚÑ]*(?=[ ,.;:\n]|$)"), F.lit(0))).alias("w"))
        every = part if every is None else every.unionAll(part)
    counts = every.groupBy("w").agg(F.count("*").alias("n"))
    rows = counts.where((F.col("n") >= 3) & (F.col("n") >= counts.agg(F.sum("n")).scalar() * F.lit(share))).collect()
    return frozenset(r.w for r in rows)


def damaged(records: DataFrame, known: frozenset[str]) -> DataFrame:
    """record_kind, record_id, restored, restorable of the damaged rows among record_kind, record_id, text."""
    held = records.sparkSession.sparkContext.broadcast(known)

    def run(rows):
        for kind, i, text in rows:
            if spans := damage(text, held.value):
                yield kind, i, restore(text, held.value), all(s[2] is not None for s in spans)

    return arrow_rows(records.where(F.col("text").rlike(GATE)), "record_kind string, record_id bigint, restored string, restorable boolean", run, 2048)


def records(pdf_documents: DataFrame, pdf_spans: DataFrame) -> DataFrame:
    spans = spread(pdf_spans.select(F.lit("pdf_span").alias("record_kind"), F.col("span_id").alias("record_id"), "text"), "record_id")
    docs = spread(pdf_documents.select(F.lit("pdf_document").alias("record_kind"), F.col("doc_id").alias("record_id"), F.col("full_text").alias("text")), "record_id")
    return docs.unionAll(spans)
