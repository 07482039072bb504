"""Problem 1: one consistent form for text that looks the same.

Method: a trie of the ordinary words of the corpus is traversed with a weighted edit automaton: look-alikes and ignorable characters
cost nothing, a letter of another script that looks like I or l may be either at a small cost, a letter that looks like another one
only from afar and an accent that no letter takes cost more; ordinary characters stand for themselves. Of the spellings reached the one
of the best balance of frequency and cost is taken. Roman numerals and tokens that reach no spelling are normalised by table. Words
quoted in a foreign script stay as they are: a word that holds a letter without Latin look-alike (and reaches no spelling), and words
of look-alikes beside such a word.

Defined results: null stays null, an empty text stays empty; typographic quotes, dashes, degree and ordinal signs are ordinary;
letters of other Latin-script languages stay; a combining accent is joined to its letter where a single character exists.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import cache
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding
from .common import arrow_rows, spread, vocabulary

#: Look-alike letters of Cyrillic and Greek with the Latin letters a reader takes them for (fixed values).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχιϳάόίΆΈΊΌ", "ABEZHIKMNOPTYXavopuxijáóíÁÉÍÓ", strict=True))
OTHERS = {"ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "−": "-", "⁃": "-", "․": ".", "⁄": "/", "∕": "/", "∶": ":", "ꓸ": ".", "‚": ",", "׃": ":", "ʼ": "'", "ʹ": "'", "ǃ": "!"}
LOOK = CYRILLIC | GREEK
#: Letters that look like a Latin one from afar: read so only inside a word of Latin letters that the corpus holds (fixed values).
AFAR = dict(zip("гкмнптувйїηκρτυωγσ", "rkmhntubñínkptuwyo", strict=True))
#: Costs of the automaton, the most that a word may cost, and how much frequency outweighs one unit of cost (a factor of e ** BALANCE).
SWAP, FAR, STRAY_ACCENT, MOST, BALANCE = 0.25, 0.75, 0.5, 1.5, 4.0
IGNORABLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︎️"
BLANKS = "               　"
SUSPECT = encoding.SUSPECT
TOKEN = re.compile(rf"[^\W\d_{IGNORABLE}](?:[^\W\d_]|[{IGNORABLE}̀-ͯ])*", re.UNICODE)
ROMAN = re.compile("[IVX]+")
COMPLEX = re.compile("[֐-ࣿऀ-෿฀-࿿က-႟ក-៿]")
EAST = re.compile("[⺀-⿿、-鿿가-힯ｦ-ﾟ]")


@cache
def plain(c: str) -> str | None:
    """What a reader takes a compatibility form for: full-width, mathematical and ligature forms; None if c is ordinary."""
    if c in OTHERS:
        return OTHERS[c]
    o = ord(c)
    if 0xFF01 <= o <= 0xFF5E or 0x1D400 <= o <= 0x1D7FF or 0xFB00 <= o <= 0xFB06 or 0x2100 <= o <= 0x2138 or 0xFE50 <= o <= 0xFE6B or 0x1F130 <= o <= 0x1F149 or 0x24B6 <= o <= 0x24E9:
        if c in "№℃℉℗℠℡™℮":
            return None
        x = unicodedata.normalize("NFKC", c)
        x = "".join(LOOK.get(k, k) for k in x)
        return x if x != c and all(k.isascii() or k in "ıȷ" for k in x) else None
    return None


#: Full-width marks that East Asian text itself uses (fixed values).
EAST_MARKS = "，．：；！？（）［］／－～％０１２３４５６７８９"


class Trie:
    """Words with counts; at most the bound of the vocabulary. Sorted words are the trie: a node is the range that shares a beginning."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.words = counts, sorted(counts)

    def _step(self, node: tuple[int, int, int], letters: str) -> tuple[int, int, int] | None:
        lo, hi, d = node
        for x in letters:
            letter = lambda w, d=d: w[d : d + 1]
            lo = bisect_left(self.words, x, lo, hi, key=letter)
            hi = bisect_right(self.words, x, lo, hi, key=letter)
            if lo == hi:
                return None
            d += 1
        return lo, hi, d

    def nearest(self, token: str) -> str | None:
        """The word that the token is read as, by frequency and cost of the edits; None if none is within reach."""
        states = {(0, len(self.words), 0): 0.0}
        for c in token:
            if c in IGNORABLE:
                continue
            nxt: dict[tuple[int, int, int], float] = {}
            for node, cost in states.items():
                for letters, more in _readings(c):
                    at = self._step(node, letters) if cost + more <= MOST else None
                    if at and cost + more < nxt.get(at, MOST + 1):
                        nxt[at] = cost + more
            states = nxt
            if not states:
                return None
        ends = [(BALANCE * cost - log(self.counts[w]), cost, w) for (lo, _, d), cost in states.items() if len(w := self.words[lo]) == d]
        return min(ends)[2] if ends else None


@cache
def _readings(c: str) -> tuple[tuple[str, float], ...]:
    """What a character may be read as, with the cost."""
    if unicodedata.combining(c):
        return (("", STRAY_ACCENT),)
    shown = plain(c) or LOOK.get(c) or c
    out = [(shown, 0.0)]
    if c in LOOK:  # letters that look alike in one case only
        out += [(x, SWAP) for x in {"I": "l", "l": "I", "O": "0"}.get(shown, "")]
    if c in AFAR:
        out.append((AFAR[c], FAR))
    return tuple(out)


def _kind(token: str) -> str:
    """latin, foreign (a letter that no reader takes for Latin), look (only look-alikes), mixed."""
    latin = look = foreign = False
    for c in token:
        if c in IGNORABLE or unicodedata.combining(c):
            continue
        if c in LOOK:
            look = True
        elif c.isascii() or "À" <= c <= "ɏ" or plain(c):
            latin = True
        else:
            foreign = True
    return "mixed" if latin and (look or foreign) else "foreign" if foreign else "look" if look else "latin"


def canonical(text: str | None, trie: Trie | None = None) -> str | None:
    """The text in its one consistent form."""
    if not text:
        return text
    composed = _compose(text)
    tokens = list(TOKEN.finditer(composed))
    kinds = [_kind(m.group()) for m in tokens]
    out, at = [], 0
    for k, m in enumerate(tokens):
        out.append(_outside(composed, at, m.start()))
        at = m.end()
        w, kind = m.group(), kinds[k]
        beside = any(0 <= k + d < len(tokens) and kinds[k + d] == "foreign" and _joined(composed, tokens[min(k, k + d)].end(), tokens[max(k, k + d)].start()) for d in (-1, 1))
        if kind == "foreign" or kind == "look" and beside or w.isascii():
            out.append(w if w.isascii() or COMPLEX.search(w) else "".join(c for c in w if c not in IGNORABLE))
            continue
        shown = "".join("" if c in IGNORABLE else plain(c) or (LOOK.get(c, c) if kind != "latin" else c) for c in w)
        if shown != w or kind == "mixed" or any(map(unicodedata.combining, w)):
            shown = trie and not ROMAN.fullmatch(shown) and trie.nearest(w) or _compose(shown)
        out.append(shown)
    out.append(_outside(composed, at, len(composed)))
    return "".join(out)


def _joined(text: str, a: int, b: int) -> bool:
    """Words of one quotation: only blanks and light marks between them."""
    return b - a <= 3 and not any(c in '"«»“”.;' for c in text[a:b])


def _compose(text: str) -> str:
    """Join combining accents to Latin letters where one character exists; other scripts keep their marks."""
    if not re.search("[̀-ͯ]", text):
        return text
    return re.sub("([A-Za-zÀ-ɏΑ-ωЀ-џ])([̀-ͯ]+)", _join, text)


def _join(m: re.Match) -> str:
    for letter in (m[1], LOOK.get(m[1], m[1])):
        if len(x := unicodedata.normalize("NFC", letter + m[2])) == 1:
            return x
    return m[0]


def _outside(text: str, a: int, b: int) -> str:
    """What lies between words: blanks, marks and digits."""
    part = text[a:b]
    if part.isascii():
        return part
    out = []
    for i, c in enumerate(part, a):
        p, n = text[i - 1 : i], text[i + 1 : i + 2]
        if c in BLANKS:
            out.append(c if c == "　" and (EAST.match(p) or EAST.match(n)) else " ")
        elif c in IGNORABLE:
            out.append(c if (COMPLEX.match(p or " ") or COMPLEX.match(n or " ")) or unicodedata.category(p or " ") == "So" else "")
        elif (x := plain(c)) is not None and not (c in EAST_MARKS and (EAST.match(p or " ") or EAST.match(n or " "))):
            out.append(x)
        else:
            out.append(c)
    return "".join(out)


def normalised(units: DataFrame, words: dict[str, int], known: frozenset[str] = frozenset(), changed_only: bool = False) -> DataFrame:
    """unit_kind, unit_id, canonical of unit_kind, unit_id, text. A span whose own text is damaged by a wrong decoding keeps its text.

    Rows of ordinary characters only are decided by a JVM expression and never reach Python.
    """
    sc = units.sparkSession.sparkContext
    held = sc.broadcast((words, known))

    def run(rows):
        trie = run.__dict__.get("trie") or run.__dict__.setdefault("trie", Trie(held.value[0]))
        for kind, i, text in rows:
            new = text if kind == "pdf_span" and encoding.damage(text, held.value[1]) else canonical(text, trie)
            if not changed_only or new != text:
                yield kind, i, new

    schema = "unit_kind string, unit_id bigint, canonical string"
    suspect = F.col("text").rlike(SUSPECT)
    treated = arrow_rows(units.where(suspect), schema, run, 2048)
    if changed_only:
        return treated
    return treated.unionAll(units.where(~suspect | F.col("text").isNull()).select("unit_kind", "unit_id", F.col("text").alias("canonical")))


def units(pdf_spans: DataFrame, text_runs: DataFrame) -> DataFrame:
    spans = spread(pdf_spans.select(F.lit("pdf_span").alias("unit_kind"), F.col("span_id").alias("unit_id"), "text"), "unit_id")
    return spans.unionAll(spread(text_runs.select(F.lit("text_run").alias("unit_kind"), F.col("run_id").alias("unit_id"), "text"), "unit_id"))


def corpus_words(*texts: DataFrame) -> dict[str, int]:
    return vocabulary(list(texts))
