"""Problem 6: noise in the text of scanned pages.

Method: running lines and page numbers are taken out, and all lines that remain are one stream of tokens with what parts them: a
blank, a line end, or a hyphen before a line end. Dynamic programming over that stream reads words jointly: a token may stand, be
corrected (confusions of glyphs, stray strokes), be joined to the next over a stray blank, a line end or a hyphen, be one of a run
of spaced letters, or be parted at a lost blank, against word counts of the whole corpus. Stretches whose tokens are all words and
cannot join are their own cheapest reading and are passed. Paragraph boundaries are the cheapest choice over all lines, where a
paragraph of one broken line costs as well. What the decoding had to undo names the noise of the document.

A word counts as misread only if the corpus holds a spelling reached by glyph confusions that is far more frequent (a ratio,
so that the decision is alike at every size), or if it holds a stroke or digit where no word has one.

Defined results: null and empty texts have no noise and stay; words damaged otherwise (look-alikes, wrong decoding) and
tokens such as addresses, dockets and amounts are left alone; a needs_ocr_pages array is not relied on; a single page has no running line;
repeated rows give one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, spread, vocabulary
from .parties import edits

#: Glyphs that scans confuse: what stands in the text, and what was printed (fixed values).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("!", "i"), ("@", "a"), ("$", "s"), ("l", "i"), ("i", "l"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("ri", "n"), ("n", "ri"), ("d", "cl"), ("cl", "d"), ("li", "h"), ("h", "li"), ("vv", "w"), ("in", "m"), ("m", "in"), ("fi", "ﬁ"), ("o", "ó"), ("nn", "m"),
)
STRAYS = "|~'`^*_\\"
LETTER = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
WORD = re.compile(rf"[{LETTER}]+")
HYPHENS = "-¬­‐"
RATIO = 25
#: Tokens up to here are read by generating variants; longer ones are compared with the words of their length.
LONG = 40
#: Shares of all words: what is rare enough to be a misreading itself, and what is frequent enough to be a part of a run-together word.
RARE, COMMON = 1e-6, 2e-4
SKIP = re.compile(r"@[\w.]+\.|\(at\)|arroba|\d{2,}|://|[^\x00-\x7FáéíóúñüÁÉÍÓÚÑÜ°º¿¡«»“”…—]")
NUMBER = r"[0-9lIOoSsBgq!|]{1,4}"
PAGE_FORMS = (
    re.compile(rf"^p[aá@]g(?:[il!1]na)?\.?\s*({NUMBER})(?:\s*(?:de|/)\s*{NUMBER})?$", re.I),
    re.compile(rf"^(?:foja|fojas|f[s5]\.?|fol[il!1]o|hoja)\s*({NUMBER})(?:\s*vta\.?)?$", re.I),
    re.compile(rf"^[-–—]\s*({NUMBER})\s*[-–—]$"),
    re.compile(r"^(\d{1,4})$"),
)


class Words:
    """Corpus counts by folded case, and the words of the corpus that are themselves frequent misreadings."""

    def __init__(self, counts: dict[str, int]):
        self.n: Counter[str] = Counter()
        for w, n in counts.items():
            self.n[w.lower()] += n
        self.total = sum(self.n.values())
        self.rare, self.common = max(3, RARE * self.total), max(200, COMMON * self.total)
        self.long = [w for w in self.n if len(w) >= LONG - 2]
        self.best = lru_cache(200_000)(self._best)
        self.simple: dict[str, str | None] = {}

    def __reduce__(self):
        return Words, (dict(self.n),)

    def count(self, w: str) -> int:
        return self.n.get(w.lower(), 0)

    def _variants(self, w: str) -> set[str]:
        out = set()
        for wrong, right in CONFUSIONS:
            at = w.find(wrong)
            while at >= 0:
                out.add(w[:at] + right + w[at + len(wrong) :])
                at = w.find(wrong, at + 1)
        for i, c in enumerate(w):
            if c in STRAYS:
                out.add(w[:i] + w[i + 1 :])
        return out

    def _best(self, w: str) -> str | None:
        """The word that was printed, if the token is a misreading by one or two confusions; else None."""
        own = self.n.get(w, 0)
        if len(w) > LONG:
            close = [(self.n[v], v) for v in self.long if v != w and edits(w, v, 2) <= 2]
            return max(close)[1] if close and max(close)[0] >= max(3, RATIO * own) else None
        first = self._variants(w)
        found = max(((self.n[v], v) for v in first if v in self.n), default=None)
        if found is None and own < self.rare:
            found = max(((self.n[x], x) for v in first for x in self._variants(v) if x in self.n), default=None)
        if found and found[1] != w and found[0] >= max(3, RATIO * own) and len(w) > 2:
            return found[1]
        return None


def _clean(token: str) -> tuple[str, int]:
    """Token without the punctuation around it, and where it begins."""
    a, b = 0, len(token)
    while a < b and token[a] in ".,;:()[]{}\"«»“”¿¡—…-":
        a += 1
    while b > a and token[b - 1] in ".,;:()[]{}\"«»“”?!—…-'":
        b -= 1
    return token[a:b], a


def misread(token: str, words: Words, own: Counter[str]) -> str | None:
    """What was printed where a token is misread ("" if it cannot be told), or None if the token may stand."""
    w, _ = _clean(token)
    if len(w) < 2 or SKIP.search(w):
        return None
    letters = sum(c.isalpha() for c in w)
    if letters * 2 < len(w) or letters < 2:
        return None
    low = w.lower()
    plain = WORD.fullmatch(w) is not None
    if plain:
        if re.search(r"[A-ZÁÉÍÓÚÑ]l[A-ZÁÉÍÓÚÑ]|^l[A-ZÁÉÍÓÚÑ]{2}|[A-ZÁÉÍÓÚÑ]{2}l$", w):  # a small l among capitals
            return w.replace("l", "I")
        if re.search(r"[a-záéíóúñ]I[a-záéíóúñ]", w):
            return w.replace("I", "l")
        if (b := words.best(low)) is not None:
            return b
        if words.count(low) < words.rare - 1 and len(low) <= LONG:  # a name that the document spells otherwise elsewhere
            return next((v for v in words._variants(low) if own.get(v, 0) > own.get(low, 0)), None)
        return None
    if not re.fullmatch(rf"[{LETTER}0-9{re.escape(STRAYS)}!@$]+", w):
        return None
    if re.fullmatch(r"[dlDLOo]'.{2,}", w) and not words.count(w.replace("'", "")):
        return None
    if re.fullmatch(rf"[A-Z]{{1,3}}\d+|\d+[{LETTER}]{{1,2}}", w):  # codes and measures
        return None
    if (b := words.best(low)) is not None:
        return b
    if words.count(low):
        return None
    inner = re.search(rf"[{LETTER}][|~!'@0-9$][{LETTER}]|^[|~!@0-9$][{LETTER}]{{3}}|[{LETTER}]{{3}}[|~@0-9$]$", w)
    digits = sum(c.isdigit() for c in w)
    if inner and digits < 2 and not re.search(r"[2347]", w):
        return next((v for v in words._variants(low) if WORD.fullmatch(v)), "") if len(low) <= LONG else ""
    return None


def skeleton(line: str) -> str:
    """A line without case, accents, digits and the glyphs that scans confuse."""
    x = line.lower().translate(str.maketrans("áéíóúü0159!@|", "aeiouuolsgia ", ""))
    x = re.sub(r"[\d~'`|]+|n°", "", x)
    x = x.replace("rn", "m").replace("ri", "n").replace("ii", "u").replace("cl", "d").replace("l", "i").replace("c", "e").replace("f", "t").replace("b", "8")
    return re.sub(r"[^a-zñ8]+", "", x)


def _number(line: str) -> int | None:
    s = line.strip()
    for form in PAGE_FORMS:
        for t in (s, re.sub(r"[~'`|]", "", s)):
            if m := form.match(t):
                digits = m.group(1).translate(str.maketrans("lI|!OoSsBgq", "1111005589" + "9"))
                return int(digits) if digits.isdigit() else None
    head = re.match(r"(\D{3,9}?)\s*(\d{1,4})(?:\s*(?:de|/|vta\.?)\s*\d{0,4})?$", s)
    if head:
        w = re.sub(r"[^a-z]", "", skeleton(head.group(1)))
        if any(edits(w, skeleton(k), 1) <= 1 for k in ("página", "foja")) and len(w) >= 3:
            return int(head.group(2))
    return None


def furniture(pages: list[list[str]]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """(page numbers, running lines) as places (page, line). Every line is looked at; away from the edges of a page a line must recur
    more strictly: a number in step on most pages, a running line on three pages at least."""
    edge: set[tuple[int, int]] = set()  # first and last three lines of a page: where numbers stand
    rim: set[tuple[int, int]] = set()  # first and last two
    told: dict[tuple[int, int], int] = {}
    for p, lines in enumerate(pages):
        real = [i for i, line in enumerate(lines) if line.strip()]
        edge |= {(p, i) for i in real[:3] + real[-3:]}
        rim |= {(p, i) for i in real[:2] + real[-2:]}
        for i in real:
            if len(lines[i]) <= 40 and (n := _number(lines[i])) is not None:
                told[p, i] = n
    numbers: set[tuple[int, int]] = set()
    steps = Counter(n - p for (p, i), n in told.items() if (p, i) in edge)
    inner = Counter(n - p for p, n in {(p, n) for (p, i), n in told.items()})
    for (p, i), n in told.items():
        if (p, i) in edge:
            sure = re.match(r"^\s*(?:p[aá@]g|[-–—]\s*\d+\s*[-–—]\s*$)", pages[p][i], re.I)
            if n - p == 1 or steps[n - p] >= 2 or sure and "de" in pages[p][i]:
                numbers.add((p, i))
        elif inner[n - p] >= 3 and inner[n - p] * 2 > len(pages):
            numbers.add((p, i))
    if len(pages) < 2:
        return numbers, set()
    # groups of lines of one skeleton, or of skeletons few edits apart that share a piece
    groups: dict[str, list[tuple[int, int]]] = {}
    by_piece: dict[tuple[int, str], list[str]] = {}
    exact: dict[str, list[tuple[int, int]]] = {}
    for p, lines in enumerate(pages):
        for i, line in enumerate(lines):
            if line.strip() and (p, i) not in numbers and len(s := skeleton(line)) >= 6:
                exact.setdefault(s, []).append((p, i))
    for s, places in exact.items():
        at_rim = any(x in rim for x in places)
        if not at_rim and len(places) < 2:
            continue  # a line of the body that occurs once
        pieces = ((0, s[:3]), (1, s[-3:]), (2, s[5:8]))
        near = dict.fromkeys(g for piece in pieces for g in by_piece.get(piece, ()))
        key = next((g for g in near if abs(len(g) - len(s)) <= 2 and edits(g, s, 3) <= min(3, max(1, len(s) // 8))), s)
        if key == s:
            for piece in pieces:
                by_piece.setdefault(piece, []).append(s)
        groups.setdefault(key, []).extend(places)
    running: set[tuple[int, int]] = set()
    for key, places in groups.items():
        outer = [x for x in places if x in rim]
        if key.startswith(("punto", "anexo")):
            continue
        for held, least in ((outer, 2), (places, 3)):
            on = {p for p, _ in held}
            if len(on) == 2 and any(pages[p][i].strip()[:1].islower() for p, i in held):  # the tails of two sentences may agree by chance
                continue
            if len(on) >= least and len(on) * 2 > len(pages):
                running |= set(held)
    return numbers, running


HYPHEN = re.compile(rf"[{LETTER}]+[{HYPHENS}]$")
REST = re.compile(rf"[{LETTER}][{LETTER}0-9!@|~']*")
NOTHING: Counter[str] = Counter()
Undone = list[tuple[str, str, str]]


def analyse(text: str, words: Words) -> tuple[str, Undone]:
    """The repaired text in paragraphs, and what was undone: (kind of noise, found, restored)."""
    pages = [p.split("\n") for p in re.split(r"\n[ \t\r]*\n", text)]
    numbers, running = furniture(pages)
    undone = [("page_number", pages[p][i], "") for p, i in sorted(numbers)] + [("running_line", pages[p][i], "") for p, i in sorted(running)]
    lines = [line.split() for p, page in enumerate(pages) for i, line in enumerate(page) if (p, i) not in numbers | running and line.strip()]
    own = Counter(w.lower() for line in lines for t in line for w in WORD.findall(t))
    tokens = [t for line in lines for t in line]
    ends = {n - 1 for n in accumulate(len(line) for line in lines)}  # tokens after which the line ends
    read = decode(tokens, ends, words, own, undone)
    return "\n\n".join(paragraphs(read)), undone


def decode(tokens: list[str], ends: set[int], words: Words, own: Counter[str], undone: Undone) -> list[str]:
    """The cheapest reading of a stream of tokens, as lines: a token read from two lines stands in the first."""
    shown: list[list[str]] = [[]]
    at = 0
    for lo, hi in [*_doubtful(tokens, ends, words), (len(tokens), len(tokens))]:
        for i in range(at, lo):
            shown[-1].append(tokens[i])
            if i in ends:
                shown.append([])
        if lo < hi:
            for i, step, text, why in _path(tokens, lo, hi, ends, words, own):
                shown[-1].append(text)
                undone += why
                if any(k in ends for k in range(i, i + step)):
                    shown.append([])
        at = hi
    return [" ".join(line) for line in shown if line]


def _plain(t: str, words: Words) -> str | None:
    """"" or, if it may be a part of a split word, the small letters of a token that can only stand as it is; None if it is in doubt."""
    simple = words.simple
    if t in simple:
        return simple[t]
    w, at = _clean(t)
    plain = WORD.fullmatch(w) is not None
    good = misread(t, words, NOTHING) is None and (not plain or words.count(w) or SKIP.search(w))
    if len(simple) > 300_000:
        simple.clear()
    # a token counts as a part of a split word only if nothing stands before it
    low = simple[t] = (w.lower() if plain and at == 0 else "") if good else None
    return low


def _doubtful(tokens: list[str], ends: set[int], words: Words) -> list[tuple[int, int]]:
    """Stretches [lo, hi) outside of which every token stands: those in doubt, those that may join, and their neighbours."""
    out: list[list[int]] = []

    def add(lo: int, hi: int) -> None:
        lo, hi = max(0, lo), min(len(tokens), hi)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])

    counts, last, letters = words.n, "", 0
    for i, t in enumerate(tokens):
        low = _plain(t, words)
        letters = letters + 1 if len(t) == 1 and t.isalpha() else 0
        if low is None:
            add(i - 1, i + 2)
        elif i in ends and HYPHEN.search(t):
            add(i, i + 2)
        elif last and low and last + low in counts:
            add(i - 1, i + 1)
        elif letters >= 3:
            add(i - 2, i + 2)
        # only a whole token may be continued, and only one without a mark behind it
        last = low if low and len(low) == len(t) else ""
    return [(a, b) for a, b in out]


def _path(tokens: list[str], lo: int, hi: int, ends: set[int], words: Words, own: Counter[str]) -> list[tuple[int, int, str, Undone]]:
    """The cheapest path over tokens[lo:hi] as (token, tokens taken, text, what was undone)."""
    n = hi - lo
    best: list[tuple[float, int, str, Undone]] = [(0.0, 0, "", [])] + [(1e9, 0, "", [])] * n
    for k in range(n):
        base = best[k][0]
        for step, text, cost, why in _readings(tokens, lo + k, hi, ends, words, own):
            if base + cost < best[k + step][0]:
                best[k + step] = (base + cost, k, text, why)
    out, k = [], n
    while k:
        _, back, text, why = best[k]
        out.append((lo + back, k - back, text, why))
        k = back
    return out[::-1]


def _readings(tokens: list[str], i: int, hi: int, ends: set[int], words: Words, own: Counter[str]) -> Iterator[tuple[int, str, float, Undone]]:
    """What tokens from i on may be read as: (tokens taken, text, cost, what is undone)."""
    t = tokens[i]
    w, _ = _clean(t)
    unknown = 0.0 if not WORD.fullmatch(w) or words.count(w) or SKIP.search(w) else 1.0
    yield 1, t, unknown, []
    fixed = misread(t, words, own)
    if fixed is not None:
        yield 1, t.replace(w, _like(w, fixed)) if fixed else t, -1.0, [("misread", w, fixed)]
    # hyphens at line ends, as many in a row as there are
    text, k, why = t, i, []
    while k in ends and k + 1 < hi and (m := HYPHEN.search(text)) and (rest := REST.match(tokens[k + 1])):
        a, b = re.search(rf"[{LETTER}]+$", text[:-1]).group(), rest.group()
        joined = a + b
        known = words.count(joined) or words.best(joined.lower())
        both = words.count(a) >= 3 and words.count(b) >= 3 and not known
        if not ((b[0].islower() or joined.isupper()) and (known or not both)):
            break
        why = [*why, ("hyphenation", f"{a}-/{b}", joined)]
        text, k = text[: m.end() - 1] + tokens[k + 1], k + 1
        again = misread(text, words, own)
        if again is None:
            yield k - i + 1, text, -2.0 * (k - i), why
        else:
            core, _ = _clean(text)
            yield k - i + 1, text.replace(core, _like(core, again)) if again else text, -2.0 * (k - i) - 1, [*why, ("misread", core, again)]
    if i + 1 < hi and WORD.fullmatch(t):
        w2, at2 = _clean(tokens[i + 1])
        if at2 == 0 and WORD.fullmatch(w2) and w2.islower():
            j, a, b = words.count(w + w2), words.count(w), words.count(w2)
            if j >= 3 and RATIO * min(a, b) <= j and len(w + w2) > 3 and not (a and w.lower() in ("a", "o", "y", "e")):
                # a word cut by a line end without a hyphen is repaired, but it is no noise of the four kinds
                yield 2, w + tokens[i + 1], -0.5, [("line_join" if i in ends else "misread", f"{w} {w2}", w + w2)]
    if len(t) == 1 and t.isalpha():  # spaced letters
        k = i
        while k < hi and len(tokens[k]) == 1 and tokens[k].isalpha() and (k == i or k - 1 not in ends):
            k += 1
        for m in range(k, i + 2, -1):
            spaced = "".join(tokens[i:m])
            if words.count(spaced) >= 3 and m - i >= 3:
                yield m - i, spaced, -1.0, [("misread", " ".join(tokens[i:m]), spaced)]
                break
    if unknown and 5 < len(w) <= LONG and fixed is None:
        cut, c = max(((min(words.count(w[:c]), words.count(w[c:])), c) for c in range(2, len(w) - 2)), default=(0, 0))
        if cut >= words.common:
            yield 1, t.replace(w, f"{w[:c]} {w[c:]}"), 0.5, [("merge", w, f"{w[:c]} {w[c:]}")]


def _like(model: str, word: str) -> str:
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def paragraphs(lines: list[str]) -> list[str]:
    """Boundaries by dynamic programming over lines. A boundary costs by how a line ends, how the next begins, and how full it is; a
    paragraph costs if it is a single line that neither ends a sentence nor is a heading, so that boundaries depend on each other."""
    if not lines:
        return []
    width = sorted(map(len, lines))[int(len(lines) * 0.8)] or 1
    ends = [bool(re.search(r"[.:!?…][\"»”)]*$", a)) for a in lines]
    heads = [a.isupper() or a.endswith(":") for a in lines]
    broken = [1.2 if not (e or h) else 0.0 for e, h in zip(ends, heads, strict=True)]
    # state: whether the line opens its paragraph; value: cost so far and the places of the boundaries
    opens: tuple[float, tuple | None] = (0.0, None)
    inside: tuple[float, tuple | None] = (1e9, None)
    for k in range(1, len(lines)):
        a, b = lines[k - 1], lines[k]
        cost = (-1.0 if ends[k - 1] else 1.2) + (-1.3 if len(a) < 0.75 * width else 0.6) + (-1.0 if heads[k - 1] else 0.0) + (0.0 if b[:1].isupper() or not b[:1].isalpha() else 1.5)
        alone, more = opens[0] + broken[k - 1] + cost, inside[0] + cost
        stay = min(opens, inside, key=lambda x: x[0])
        opens = (alone, (k, opens[1])) if alone <= more else (more, (k, inside[1]))
        inside = stay
    _, path = min(opens, inside, key=lambda x: x[0])  # the last line may be cut off
    cuts = [len(lines)]
    while path:
        cuts.append(path[0])
        path = path[1]
    cuts = [0, *cuts[::-1]]
    return [" ".join(lines[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def corpus_words(documents: DataFrame) -> Words:
    return Words(vocabulary([documents.select("full_text")], least=2))


def noise(documents: DataFrame, words: Words | None = None) -> DataFrame:
    """doc_id, noise_kind, n, example, of every kind of noise found in a document."""
    held = documents.sparkSession.sparkContext.broadcast(words or corpus_words(documents))

    def run(rows) -> Iterator[tuple]:
        for i, text in rows:
            if text:
                kinds: dict[str, list] = {}
                for kind, found, restored in analyse(text, held.value)[1]:
                    if kind not in ("merge", "line_join"):
                        kinds.setdefault(kind, []).append(f"{found} > {restored}")
                for kind, found in kinds.items():
                    yield i, kind, len(found), found[0]

    return arrow_rows(spread(documents.select("doc_id", "full_text"), "doc_id"), "doc_id bigint, noise_kind string, n int, example string", run)


def repaired(documents: DataFrame, words: Words | None = None) -> DataFrame:
    """doc_id, paragraphs of every document."""
    held = documents.sparkSession.sparkContext.broadcast(words or corpus_words(documents))

    def run(rows) -> Iterator[tuple]:
        for i, text in rows:
            yield i, (analyse(text, held.value)[0].split("\n\n") if text and text.strip() else None if text is None else [])

    return arrow_rows(spread(documents.select("doc_id", "full_text"), "doc_id"), "doc_id bigint, paragraphs array<string>", run)
