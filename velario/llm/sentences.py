"""Problem 5: sentence units across languages and scripts.

Method: in spaced scripts the terminators (with their closing marks) form a lattice: at each one the sentence ends or goes on. Costs
of a node come from the word before (abbreviation, initial, ordinal), the word after (case, opener) and the state of quotes and
brackets; the cost of an edge from what the piece between two boundaries would be (a piece without a word is no sentence). The
cheapest path decides all of them at once. Spaceless scripts are cut into words by the cheapest path through a lattice of dictionary
words; the dictionary, and which words end and open sentences, are counted over all rows (``learn``) and joined with a few fixed
particles. A gap without a terminator is then a boundary by the last word before it and the first word after it: a blank or line
end in Chinese and Japanese, a line end in Thai. A blank beside Thai parts two sentences by definition. No gap inside a quotation
is a boundary.

Defined results: null, empty and blank texts have no unit; units are trimmed of blanks and keep closing marks and quotes; an
empty line ends a unit; a line break alone does not; a long unbroken run on its own line is a unit; the rest of a cut-off text
is a unit. The script at a place decides, not a language column. Offsets count code points within the row's own text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, spread

#: Abbreviations that always want a continuation (fixed values).
LEADING = frozenset(
    """sr sra srta sres dr dra dres lic ing arq prof mg mag gral cnel av avda bv bvd pje art arts artículo inc incs fs fol fojas f p pp pág págs pto ptos
    cód cod cap ed edit op ob cit cfr cf conf vgr ej nro núm num n nº exp expte res reg t tomo vol sec s/ aprox cra c v vs dpto depto tel cel civ
    mr mrs ms st fig figs e.g i.e viz
    m mme mlle mm me al l hr fr nr abs z d b bzw vgl ca usw.u s gem ziff
    п ст см т ул гл стр им рис e exmo exma ilmo ilma dna dn dña d""".split()
)
#: Abbreviations only before a number, since they are words too (fixed values).
NUMBERED = frozenset("no nos para paras jan feb mar apr may jun jul aug sep sept oct nov dec".split())
#: Abbreviations that also end sentences: only an opening word after them makes a break.
TRAILING = frozenset("etc ltd ltda inc corp co hs hrs h vta vto ppal sgtes sgte ss uu ee ff rr seq p.m a.m pm am jr sr.jr г руб т.д т.п др коп тыс млн kg km cm mm min seg máx mín".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split())
#: Words that open sentences rather than continue names (fixed values).
OPENERS = frozenset(
    """el la los las lo un una en de del al a por para con sin según sobre se que no si como ahora así atento abierta cabe corrida hubo llegado preguntó respecto
    reseñados tras trabajó vencido ver vive y dijo su escribió la notifíquese regístrese además además em nos não quanto por em the on in as did it moreover see
    le les des en par dès sur cf il elle am der die das es er wer vgl zudem in жалоба истец кто см свидетель сумма мотивы this that these they he she we i""".split()
)
TERMINATOR = re.compile("[.!?…‥։؟۔।॥。！？｡．]+")
CLOSERS = "\"'”’»›)]}」』】）〉》“"
OPEN = {"«": "»", "‹": "›", "„": "“”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "“": "”"}
THAI = re.compile("[฀-๿຀-໿က-႟ក-៿]")
THAI_FIRST = re.compile("[฀-๿຀-໿က-႟ក-៿]+")
EAST = re.compile("[぀-ヿ一-鿿㐀-䶿]")
EAST_FIRST = re.compile("[぀-ヿ一-鿿㐀-䶿]+")
GAP = re.compile(r"\s+")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
RUN = re.compile(r"(?m)(?:(?<=\n)|\A)[ \t]*([A-Za-z0-9+/=_\-.:%&?#~]{24,})[ \t\r]*(?=\n|\Z)")

#: A small dictionary of the spaceless scripts: final particles and opening words (fixed values).
FINALS = tuple("です ます ました ません でした た だ か ね よ 了 吗 呢 吧 啊 的 ครับ ค่ะ คะ นะ แล้ว ด้วย สัญญา คำร้อง เหตุการณ์ บาท".split())
STARTERS = tuple("原告 被告 証人 裁判所 控訴 契約 誰 法院 证人 合同 上诉 鉴定 谁 โจทก์ จำเลย ศาล พยาน ค่าเสียหาย และ แต่".split())
#: Finals that end a sentence whatever opens the next line; after the others only an opening word makes a boundary (fixed values).
SURE = frozenset("です ます ました ません でした 吗 呢 吧".split())
#: Words that end like a final particle and yet carry on, and Thai words that want a continuation (fixed values).
BOUND = frozenset("また ただ まだ 未だ あなた ほか 静か 確か わずか いずれか 为了 除了 目的 的 ว่า ที่ ของ และ แต่ กับ ให้ โดย จาก ตาม หรือ ซึ่ง".split())
CARRY = ("と", "って", "との", "という", "は", "が", "を", "に", "の", "も", "、", "，", ",", "地说", "说")


class Lexicon:
    """Words of the spaceless scripts with their costs, and the words that end and open sentences."""

    def __init__(self, counts: dict[str, int] | None = None, finals: frozenset[str] = frozenset(), openers: frozenset[str] = frozenset()):
        fixed = (*FINALS, *STARTERS, *BOUND, *CARRY[:10])
        self.finals, self.openers = frozenset(FINALS), frozenset(STARTERS)
        self.learnt_finals, self.learnt_openers = finals - self.finals - BOUND, openers - self.openers - BOUND - set(CARRY)
        self.cost = {w: 0.5 for w in fixed}
        counts = counts or {}
        total = sum(n for w, n in counts.items() if len(w) == 1)
        for w, n in counts.items():
            # a word hangs together: it is far more frequent than its parts would make it
            if len(w) > 1 and w not in self.cost and all(n * total > COHESION * counts.get(w[:k], n) * counts.get(w[k:], n) for k in range(1, len(w))):
                self.cost[w] = 0.9  # cheaper than single characters, dearer than a particle
        self.longest = max(map(len, self.cost))


#: How far above chance a word must be; longest learnt word; share of a word's places that must lie at an end or a beginning.
COHESION, LONGEST_WORD, AT_ENDS = 8, 4, 0.5
#: A gram counts from this share of all characters on, so at most LONGEST_WORD / GRAM_SHARE grams are collected at any size.
GRAM_SHARE, LEAST_GRAMS = 2e-5, 4
EASTERN = "\\u3040-\\u30ff\\u4e00-\\u9fff\\u3400-\\u4dbf"
DEFAULT = Lexicon()


def segments(run: str, lexicon: Lexicon = DEFAULT) -> list[str]:
    """Words of the cheapest path through the lattice of dictionary words and single characters of an unbroken run."""
    n, costs = len(run), lexicon.cost
    best, back = [0.0] + [1e18] * n, [0] * (n + 1)
    for i in range(n):
        for k in range(1, min(lexicon.longest, n - i) + 1):
            cost = costs.get(run[i : i + k], 1.0 if k == 1 else 1e9)
            if best[i] + cost < best[i + k]:
                best[i + k], back[i + k] = best[i] + cost, i
    out, at = [], n
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def learn(rows: DataFrame) -> Lexicon:
    """The dictionary of Chinese and Japanese counted over all rows of a column ``text`` (Thai gaps are decided by blanks and the fixed words).

    Only unbroken runs of those scripts are counted."""
    held = rows.where(F.col("text").rlike(f"[{EASTERN}]")).select(F.explode(F.regexp_extract_all("text", F.lit(f"[{EASTERN}。！？]+"), F.lit(0))).alias("run"))
    total = held.agg(F.sum(F.length("run"))).first()[0] or 0

    def found(kind: str, before: str, after: str, least: int) -> DataFrame:
        """All places of every word of ``least`` letters or more between the two marks, by lookahead: one pass for each length."""
        words_of = [F.regexp_extract_all("run", F.lit(f"{before}(?=([{EASTERN}]{{{n}}}){after})"), F.lit(1)) for n in range(least, LONGEST_WORD + 1)]
        return held.select(F.explode(F.concat(*words_of)).alias("w"), F.lit(kind).alias("kind"))

    counted = (
        found("n", "", "", 1).unionAll(found("end", "", "[。！？]", 2)).unionAll(found("open", "[。！？]", "", 2))
        .groupBy("w").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("n", "end", "open")])
    )
    got = counted.where(F.col("n") >= max(LEAST_GRAMS, total * GRAM_SHARE)).collect()
    finals = frozenset(r.w for r in got if len(r.w) > 1 and r.end >= AT_ENDS * r.n)
    openers = frozenset(r.w for r in got if len(r.w) > 1 and r.open >= AT_ENDS * r.n)
    return Lexicon({r.w: r.n for r in got}, finals, openers)


def _tail(text: str, letters: re.Pattern) -> str:
    """The letters that end a text."""
    k = len(text)
    while k and letters.match(text[k - 1]):
        k -= 1
    return text[k:]


def gap_ends(text: str, start: int, end: int, lexicon: Lexicon = DEFAULT, since: int = 0) -> bool:
    """Whether the gap text[start:end] (blanks or a line end, no terminator before it) beside a spaceless script ends a sentence.
    ``since``: the end of the gap before, where the unbroken run before this one can begin at the earliest."""
    after = GAP.search(text, end)
    left, right = text[since:start], text[end : after.start() if after else len(text)]
    thai_l, thai_r = _tail(left, THAI), THAI_FIRST.match(right)
    finals, starters = lexicon.finals, lexicon.openers
    if thai_l or thai_r:
        if not ((thai_l or left[-1:].isdigit() or left[-1:] in CLOSERS) and (thai_r or right[:1].isdigit() or right[:1] in "\"“«(")):
            return False
        if "\n" not in text[start:end]:
            return True
        last = segments(thai_l, lexicon)[-1] if thai_l else ""
        return last not in BOUND and (last in finals or bool(thai_r) and segments(thai_r.group(), lexicon)[0] in starters)
    east_l, east_r = _tail(left, EAST), EAST_FIRST.match(right)
    if not east_l:
        return False
    last = segments(east_l, lexicon)[-1]
    if last in lexicon.learnt_finals and east_r:  # a word that ends sentences elsewhere, before one that opens them
        first = segments(east_r.group(), lexicon)[0]
        return first in starters or first in lexicon.learnt_openers
    if last in BOUND or last not in finals:
        return False
    if not east_r:
        return last in SURE and (right[:1].isdigit() or right[:1] in OPEN and right[:1] not in "(（[")
    first, *rest = segments(east_r.group(), lexicon)
    if last in ("た", "だ"):  # a plain past may also belong to the noun after it: only a topic opens a sentence
        return first in starters and rest[:1] in (["は"], ["が"], ["も"])
    return first in starters or last in SURE and first not in CARRY and first not in finals


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans between paired quotes and brackets, outermost only; an unpaired opening quote reaches the end of a cut-off text."""
    out: list[tuple[int, int]] = []
    base = 0
    for para in PARAGRAPH.split(text):
        base = text.index(para, base) if para else base
        stack: list[tuple[str, int]] = []
        top: int | None = None  # place of the straight quote in the stack; a second one closes it
        for i, c in enumerate(para, base):
            if c == '"':
                p, n = text[i - 1 : i], text[i + 1 : i + 2]
                is_open = (not p or p.isspace() or p in "(¿¡[—-:") and bool(n) and not n.isspace()
                if top is not None:
                    start = stack[top][1]
                    del stack[top:]
                    top = None
                    if not stack:
                        out.append((start, i + 1))
                elif is_open:
                    top = len(stack)
                    stack.append(('"', i))
            elif stack and stack[-1][0] != '"' and c in stack[-1][0]:
                _, start = stack.pop()
                if not stack:
                    out.append((start, i + 1))
            elif c in OPEN:
                stack.append((OPEN[c], i))
        if stack and base + len(para) >= len(text.rstrip()) and stack[0][0] not in (")", "]"):
            out.append((stack[0][1], len(text)))
        elif stack:  # unpaired: what is paired after it still counts
            first = stack[0][1]
            out += [(first + 1 + a, first + 1 + b) for a, b in quoted(text[first + 1 : base + len(para)]) if first + 1 + b < len(text)] if len(stack) < 3 else []
        base += len(para)
    return out


def _before(text: str, i: int) -> str:
    """The word that ends before place i, dots inside included."""
    a = i
    while a and not text[a - 1].isspace() and text[a - 1] not in "([{\"'«»“”„‘’¿¡,;:":
        a -= 1
    return text[a:i]


FIRST_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _cost(text: str, start: int, end: int, after: int) -> float:
    """Cost of a break after text[start:end] (terminator with closers) minus the cost of going on; ``after``: next word's place."""
    mark = text[start:end]
    n = text[after : after + 1]
    if not n:
        return -9
    closed = any(c in CLOSERS for c in mark)
    word_after = FIRST_WORD.match(text, after, after + 40)
    w = word_after.group() if word_after else ""
    if EAST.match(n) or mark[0] in "。！？｡．":
        if closed and text.startswith(CARRY, after):
            return 5
        return -5 if mark[0] in "。！？｡．!?" or closed else 5
    if end == after:  # no blank after it: decimals, addresses, file names
        return 9
    if n.islower():
        return 5
    if n in ",;:)]}»”":
        return 9
    if mark[0] in "!?؟।॥۔։":
        return -5
    if mark[:1] in "…‥" or mark.startswith("..."):
        return -3 if n.isupper() or n in "¿¡\"«“" else 2
    if closed:
        return -5
    word = _before(text, start)
    bare = word.lower()
    if not bare:
        return -2
    last = bare.rsplit(".", 1)[-1]
    opener = w.lower() in OPENERS and (w[:1].isupper() or not w.isascii())
    if bare in LEADING or last in LEADING and "." in bare and bare not in TRAILING and not re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", bare):
        return 6
    if bare in NUMBERED and n.isdigit():
        return 6
    if re.fullmatch(r"([A-Z])\1", word) and re.match(r"([A-Z])\1\.", text[after : after + 3]):  # doubled letters of a plural: EE. UU.
        return 6
    if bare in TRAILING or last in TRAILING:
        return -3 if w[:1].isupper() or not word_after and n in "¿¡\"«“—" else 3
    if re.fullmatch(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}", word) and word[:1].isupper():  # S.A, S.R.L, D.N.I
        if re.match(r"(?:N[°ºr]|n[°º])|\d", text[after : after + 2]):
            return 4
        return -3 if w[:1].isupper() or n in "¿¡\"«“—" else 3
    if re.fullmatch(r"[^\W\d_]", word) and word.isupper():  # an initial, or a numeral that an opener follows
        return -1 if opener else 5
    if re.fullmatch(r"\d{1,2}", word) and w.lower() in MONTHS:
        return 5
    return -5


def breaks(text: str, spans: list[tuple[int, int]] | None = None) -> list[int]:
    """Places (ends of units, before trimming) after the terminators that end a sentence; ``spans``: those of quoted()."""
    spans = quoted(text) if spans is None else spans
    inside = sorted(s for s in spans if s[1] - s[0] > 1)  # outermost, so disjoint: one search finds the one that holds a place
    starts, opens = [a for a, _ in inside], {a for a, _ in spans}
    nodes: list[tuple[int, float, bool]] = []
    for m in TERMINATOR.finditer(text):
        end = m.end()
        while end < len(text) and (text[end] in CLOSERS or (text[end] in "   " and text[end + 1 : end + 2] and text[end + 1] in "»")):
            if text[end] == '"' and end in opens:
                break
            if text[end] == "“" and end in opens:
                break
            end += 1
        after = end
        while after < len(text) and text[after].isspace():
            after += 1
        k = bisect_left(starts, m.start()) - 1
        held = k >= 0 and m.start() < inside[k][1] and end < inside[k][1]
        nodes.append((end, _cost(text, m.start(), end, after), held))
    return _cheapest(text, nodes)


#: Dearer than any gain: a break inside a quotation that is still open; and what a piece without a word costs as a sentence.
OPEN_QUOTE, NO_WORD = 20.0, 4.0


def _cheapest(text: str, nodes: list[tuple[int, float, bool]]) -> list[int]:
    """The cheapest path through the lattice: one state for each terminator that may be the last boundary, or none.

    A boundary pays its own cost, and NO_WORD if nothing between it and the boundary before is a word. Only boundaries up to the first
    word behind them can pay that, so a state further back is as good as any and one best state stands for all of them.
    """
    far: tuple[float, tuple | None] = (0.0, None)  # best path whose last boundary has a word behind it
    near: list[tuple[float, tuple | None]] = []  # paths whose last boundary has none yet
    at = 0
    for end, cost, held in nodes:
        if ANY_WORD.search(text, at, end):
            far = min([far, *near], key=lambda x: x[0])
            near = []
        at = end
        own = cost + (OPEN_QUOTE if held else 0.0)
        worded = bool(ANY_WORD.search(text, 0, end)) if far[1] is None else True
        options = [(far[0] + own + (0.0 if worded else NO_WORD), (end, far[1]))] + [(c + own + NO_WORD, (end, path)) for c, path in near]
        near = [*near, min(options, key=lambda x: x[0])]
    _, path = min([far, *near], key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


ANY_WORD = re.compile(r"[^\W_]")


def units(text: str | None, lexicon: Lexicon = DEFAULT) -> list[tuple[int, int]]:
    """Sentence units of a text as (start, end)."""
    if not text or text.isspace():
        return []
    spans = sorted(quoted(text))
    ends = set(breaks(text, spans))
    for m in PARAGRAPH.finditer(text):
        ends.add(m.start())
    for m in RUN.finditer(text):
        if not m.group(1).isalpha() or len(m.group(1)) >= 40:
            ends |= {m.start(1), m.end(1)}
    if THAI.search(text) or EAST.search(text):
        starts, since = [a for a, _ in spans], 0
        for m in GAP.finditer(text):
            k = bisect_left(starts, m.start()) - 1
            if not (k >= 0 and m.end() < spans[k][1]) and gap_ends(text, m.start(), m.end(), lexicon, since):
                ends.add(m.start())
            since = m.end()
    out, at = [], 0
    for e in [*sorted(ends), len(text)]:
        a, b = at, e
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        at = max(at, e)
    return out


def sentence_units(rows: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """unit_kind, unit_id, sent_no, char_start, char_end, sentence of unit_kind, unit_id, text."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon or learn(rows))

    def run(rows) -> Iterator[tuple]:
        for kind, i, text in rows:
            for k, (a, b) in enumerate(units(text, held.value)):
                yield kind, i, k + 1, a, b, text[a:b]

    return arrow_rows(spread(rows.where(F.col("text").isNotNull()), "unit_id"), "unit_kind string, unit_id bigint, sent_no int, char_start int, char_end int, sentence string", run)


def inputs(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    a = sentences.select(F.lit("sentence").alias("unit_kind"), F.col("sentence_id").alias("unit_id"), "text")
    return a.unionAll(chunks.select(F.lit("chunk").alias("unit_kind"), F.col("chunk_id").alias("unit_id"), "text"))
