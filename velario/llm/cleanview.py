"""A clean view of a damaged text with the offset of every character in the stored text.

Look-alikes, ignorables, wrong decodings, hyphens at line ends, page furniture and strokes inside words are undone in the view;
``offset[i]`` is the place in the stored text of character i of the view.
"""

from __future__ import annotations

import re
import unicodedata

from . import encoding, lookalike, scans

#: Accented given names, for damage that only a known word can tell (fixed values).
KNOWN = frozenset(x for w in "José Ángel Tomás Andrés Inés Héctor Néstor Raúl María Mónica Verónica Lucía Matías Julián Ramón".split() for x in (w, w.upper()))
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ�"
STROKE = re.compile(rf"(?<=[{LETTER}])[|~`^](?=[{LETTER}])|(?<=[{LETTER}]{{2}})'(?=[{LETTER}])|(?<=[{LETTER}])'(?=[{LETTER}]{{3}})")
GLYPH = re.compile(rf"(?<![\w@.])[{LETTER}]*(?:[0159!@8$][{LETTER}]+|[{LETTER}]+[0159!@8$])[{LETTER}]*(?![\w@/-])")
#: A figure or sign beside a letter: where a misread word may be.
ODD = re.compile(rf"[0159!@8$](?=[{LETTER}]{{2}})|(?<=[{LETTER}])[0159!@8$]")
DOMAIN = re.compile(r"@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}")
OTHER = re.compile(r"[^\x00-\x7f]")
WORDLIKE = re.compile(rf"[{LETTER}0159!@8$]")
GLYPHS = str.maketrans({"0": "o", "1": "l", "5": "s", "9": "g", "!": "i", "@": "a", "8": "b", "$": "s"})
HYPHEN = re.compile(rf"(?<=[{LETTER}])[-¬­‐][ \t\r]*\n\s*(?=[{LETTER}])")


def view(text: str, pages: bool) -> tuple[str, list[int]]:
    """The clean view and its offsets; ``pages``: empty lines part pages, whose furniture is left out."""
    chars, at = text, list(range(len(text)))
    if re.search(encoding.SUSPECT, text):
        spans, last = encoding.next_repair(chars, KNOWN)
        while spans:
            chars, at = _splice(chars, at, spans)
            spans, last = encoding.next_repair(chars, KNOWN, last)
        chars, at = _plain(chars, at)
    if pages and "\n\n" in text:
        chars, at = _without_furniture(chars, at)
    if pages:  # a sentence goes on over the end of a page
        edits = [(m.start() + 1, m.end(), "") for m in re.finditer(r"(?<=[^\s.:;!?])\n[ \t\r]*\n", chars)]
        if edits:
            chars, at = _splice(chars, at, edits)
    edits = [(m.start(), m.end(), "") for m in HYPHEN.finditer(chars) if chars[m.end()].islower() or chars[m.start() - 2 : m.start()].isupper() and chars[m.end() : m.end() + 2].isupper()]
    if edits:
        chars, at = _splice(chars, at, edits)
    edits = [(m.start(), m.end(), "") for m in STROKE.finditer(chars)] if any(c in chars for c in "|~`^'") else []
    if edits:
        chars, at = _splice(chars, at, edits)
    edits = []
    seen = -1
    for place in ODD.finditer(chars):
        if place.start() < seen:
            continue
        a = place.start()
        while a and WORDLIKE.match(chars[a - 1]):
            a -= 1
        m = GLYPH.match(chars, a)
        if not m:
            continue
        w, seen = m.group(), m.end()
        if "@" in w and DOMAIN.match(chars, chars.index("@", m.start())):  # an address of mail
            continue
        if sum(c.isalpha() for c in w) >= 3 and sum(not c.isalpha() for c in w) == 1 and not re.match(r"[A-Z]{2,3}\d", w):
            new = w.translate(GLYPHS)
            if sum(c.isupper() for c in w) > 1:
                new = "".join(n.upper() if n != c else c for n, c in zip(new, w, strict=True))
            edits.append((m.start(), m.end(), new))
    if edits:
        out = list(chars)
        for a, b, new in edits:
            out[a:b] = new
        chars = "".join(out)
    return chars, at


def _splice(chars: str, at: list[int], spans: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    out, places, k = [], [], 0
    for a, b, new in spans:
        out.append(chars[k:a])
        places += at[k:a]
        out.append(new)
        places += [at[a]] * len(new) if new else []
        k = b
    out.append(chars[k:])
    return "".join(out), places + at[k:]


def _plain(chars: str, at: list[int]) -> tuple[str, list[int]]:
    """Ordinary characters for look-alikes, with letters and their accents composed."""
    tokens = list(lookalike.TOKEN.finditer(chars))
    kinds = ["latin" if m.group().isascii() else lookalike._kind(m.group()) for m in tokens]
    swap = bytearray(len(chars))
    for k, m in enumerate(tokens):
        near = any(0 <= k + d < len(tokens) and kinds[k + d] == "foreign" and abs(tokens[k + d].start() - m.start()) < 25 for d in (-1, 1))
        if kinds[k] == "mixed" or kinds[k] == "look" and not near:
            for i in range(m.start(), m.end()):
                swap[i] = 1
    out: list[str] = []
    places: list[int] = []
    k = 0
    for m in OTHER.finditer(chars):
        i, c = m.start(), m.group()
        out.append(chars[k:i])
        places += at[k:i]
        k = i + 1
        if c in lookalike.IGNORABLE and not (c == "­" and chars[k : k + 1] == "\n"):
            continue
        if c in lookalike.BLANKS:
            out.append(" ")
        elif unicodedata.combining(c):
            last = next((x for x in range(len(out) - 1, -1, -1) if out[x]), None)
            if last is not None and len(x := unicodedata.normalize("NFC", out[last][-1] + c)) == 1:
                out[last] = out[last][:-1] + x
            continue
        elif (x := lookalike.plain(c)) is not None:
            out.append(x)
            places += [at[i]] * (len(x) - 1)
        else:
            out.append(lookalike.LOOK.get(c, c) if swap[i] else c)
        places.append(at[i])
    out.append(chars[k:])
    places += at[k:]
    return "".join(out), places


def _without_furniture(chars: str, at: list[int]) -> tuple[str, list[int]]:
    pages = [p.split("\n") for p in re.split(r"\n[ \t\r]*\n", chars)]
    numbers, running = scans.furniture(pages)
    if not numbers and not running:
        return chars, at
    drop, place = [], 0
    page = line = 0
    # lines in order of the text; an empty line moves to the next page
    for raw in chars.split("\n"):
        if not raw.strip() and place and line:
            page, line = page + 1, 0
            drop.append((place, min(len(chars), place + len(raw) + 1), ""))
        else:
            if (page, line) in numbers | running:
                drop.append((place, min(len(chars), place + len(raw) + 1), ""))
            line += 1
        place += len(raw) + 1
    return _splice(chars, at, drop)
