"""Names of private persons: a skip-chain conditional random field over the capitalised words of each document.

Nodes are capitalised words, labelled person or other. Node potentials come from weighted features of the word and its context;
chain edges join words side by side; skip edges join occurrences of the same or a similarly spelled word anywhere in the document,
so that a clear mention decides unclear ones. Loopy belief propagation runs over all documents of a batch in one graph.

Features name words only if they are ordinary: context words in small letters, titles and offices, and capitalised words that rulings
also write in small letters. No name is a feature, so an unseen name is judged like a seen one, by its form and its surroundings.
The weights are trained piecewise (Sutton and McCallum) by ``train_persons``; they are kept in ``persons_model.json``.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from pathlib import Path

import numpy as np

from .common import fold
from .parties import GIVEN, KIND_WORDS, KINDS, LINKS, NICKNAMES, TITLES, code
from .sentences import OPENERS

UP, LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ�"
NODE = re.compile(rf"(?<![\w@�])(?:[{UP}](?=\.)|[{UP}�][{UP}{LOW}']*[{UP}{LOW}])(?![\w@/�]|\.\w)")
WORD = re.compile(rf"[{UP}{LOW}]+")
STREETS = frozenset("calle pasaje avenida av avda bv bvd diagonal pje ruta camino bulevar".split())
ORG = frozenset(KINDS) | frozenset(KIND_WORDS)
#: Words of numbers, headings and formulas that no name holds (fixed values).
NEVER = frozenset("cuil cuit cul le lc dni cbu cbus expte protocolicese registrese notifiquese anexo punto ii iii iv vi vii viii ix vistos considerando resuelvo sala camara voto vocal copia traslado poder obligaciones primero segundo".split())
#: Offices whose holders are no private persons (fixed values).
OFFICES = frozenset(
    """juez jueza jueces magistrado magistrada magistrados vocal vocales camarista camaristas ministro ministra ministros fiscal fiscales secretario secretaria presidente presidenta defensor defensora
    prosecretario actuario actuaria gobernador intendente comisario escribano escribana autor autora profesor jurista tratadista""".split()
)
FEW = 3


#: A legal form after a name, in capitals as printed.
LEGAL = re.compile(r"\s*,?\s*(?:S\.\s?A\.|S\.?\s?R\.?\s?L\b|S\.\s?R\.\s?L\.|SA\b|S\.a\.|S\.r\.l|LTDA\b|Ltda\b|Limitada\b|LIMITADA\b|Sociedad\s+An|SOCIEDAD\s+AN|Soc\.)")


class Node:
    __slots__ = ("end", "features", "fold", "gap", "join", "run", "shape", "start", "start_of_sentence", "twin")


def nodes(text: str, taken: list[tuple[str, int, int]]) -> list[Node]:
    """Capitalised words outside the structured finds, with their features."""
    covered = [(a, b) for _, a, b in taken]
    out: list[Node] = []
    k = 0
    lower = set(re.findall(r"(?<![\w�])[a-zß-öø-ÿ]{3,}", text))
    for m in NODE.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] < m.end():
            continue
        f = fold(m.group())
        if f in TITLES or f.replace("�", "i") in NEVER or f in OPENERS and not m.group().isupper():
            continue
        n = Node()
        n.start, n.end, n.fold = m.start(), m.end(), f
        w = m.group()
        n.shape = "I" if len(w) == 1 else "U" if w.isupper() else "T"
        n.twin = w.lower() in lower
        out.append(n)
    _runs(text, out)
    for group in _groups(out):
        shared = _surroundings(text, group)
        for k, n in enumerate(group):
            n.features = _features(n, k, group, shared)
    return out


def _runs(text: str, ns: list[Node]) -> None:
    """gap to the node before: blank, comma, or none."""
    run = -1
    for i, n in enumerate(ns):
        n.gap = ""
        at = n.start
        while at and text[at - 1].isspace():
            at -= 1
        n.start_of_sentence = not at or text[at - 1] in ".:;!?" and not (i and ns[i - 1].shape == "I" and ns[i - 1].end == at - 1) or text[n.start - 2 : n.start] == "\n\n"
        if i:
            between = text[ns[i - 1].end : n.start]
            if ns[i - 1].shape == "I" and re.fullmatch(r"\.\s{0,2}", between) or re.fullmatch(r"[ \t]+|[ \t]*\r?\n[ \t]*", between):
                n.gap = "blank"
            elif re.fullmatch(r",(?:[ \t]+|[ \t]*\r?\n[ \t]*)", between):
                n.gap = "comma"
        if n.gap != "blank":
            run += 1
        n.run = run


def _groups(ns: list[Node]) -> list[list[Node]]:
    groups: list[list[Node]] = []
    for n in ns:
        if groups and groups[-1][0].run == n.run:
            groups[-1].append(n)
        else:
            groups.append([n])
    return groups


def _context(word: str) -> str:
    """A word around a run as a feature: itself in small letters or if it is a title or office, else only that it is capitalised."""
    f = fold(word)
    return f if word[0].islower() or f in TITLES or f in OFFICES else "<X>"


def _surroundings(text: str, run: list[Node]) -> list[str]:
    """Features that all words of a run share: the words and marks around it, and what it holds."""
    a, b = run[0].start, run[-1].end
    left = text[max(0, a - 60) : a]
    lw = [_context(w) for w in WORD.findall(left)[-3:]]
    right = text[b : b + 60]
    rw = [_context(w) for w in WORD.findall(right)[:2]]
    lp = LAST_MARKS.search(left).group().strip()[-1:] if left else "^"
    rp = FIRST_MARKS.match(right).group().strip()[:1]
    folds = {x.fold for x in run}
    l1, r1 = lw[-1] if lw else "^", rw[0] if rw else "$"
    fs = ["bias", f"l={l1}|{lp}", f"l={l1}", f"r={r1}|{rp}", f"r={r1}", f"lp={lp}|{rp}", f"len={min(len(run), 4)}|{lp}"]
    fs += [f"m={w}" for w in lw[:-1] if w != "<X>"] + [f"q={w}" for w in rw[1:] if w != "<X>"]
    if any(w in OFFICES for w in lw) or any(w in OFFICES for w in rw):
        fs.append("office")
    if lw and lw[-1] in OFFICES:
        fs.append("after_office")
    if lw and lw[-1] in TITLES:
        fs.append("after_title")
    if folds & ORG:
        fs.append("org")
    if LEGAL.match(right) or folds & {"ltda", "limitada", "anonima"}:
        fs.append("legal")
    if lw and lw[-1] in STREETS and not lp:
        fs.append("street")
    if folds & GIVEN:
        fs.append("run_given")
    return fs


LAST_MARKS, FIRST_MARKS = re.compile(r"[^\w\s]*\s*$"), re.compile(r"\s*[^\w\s]*")


def _features(n: Node, k: int, run: list[Node], shared: list[str]) -> list[str]:
    place = "first" if k == 0 else "last" if k == len(run) - 1 else "mid"
    f = n.fold
    opens = n.start_of_sentence and k == 0
    fs = [
        *shared, f"shape={n.shape}", f"w={f}", f"at={place}|{n.shape}", f"twin={n.twin}|{n.shape}|{opens}", f"start={n.start_of_sentence}",
        f"gap={run[0].gap}|{n.shape}", f"opens={opens}|{len(run) > 1}|{n.shape}",
    ]
    if opens and len(run) > 1 and n.shape == "T":  # a verb that opens a sentence before a name: its ending tells
        fs += [f"verb={f[-2:]}", f"verb={f[-3:]}", f"verb={f[-4:]}"]
    if k:
        fs.append(f"p={run[k - 1].shape}|{run[k - 1].fold in GIVEN}|{run[k - 1].start_of_sentence}")
    if f in NICKNAMES or f in GIVEN:
        fs.append("given")
    return fs


class Model:
    """Feature weights and edge strengths."""

    def __init__(self, weights: dict[str, float], edges: dict[str, float]):
        self.weights, self.edges = weights, edges

    @classmethod
    def load(cls) -> Model:
        d = json.loads((Path(__file__).parent / "persons_model.json").read_text())
        return cls(d["weights"], d["edges"])

    def score(self, n: Node) -> float:
        w = self.weights
        return sum([w[f] for f in n.features if f in w])


def edge_type(a: Node, b: Node) -> str:
    return f"{b.gap}|{a.shape}{b.shape}|{a.twin and a.start_of_sentence}"


def graph(docs: list[list[Node]], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node scores, edge ends i and j, edge strengths) of all documents."""
    h, i, j, a = [], [], [], []
    base = 0
    for ns in docs:
        last: dict[str, int] = {}
        for k, n in enumerate(ns):
            h.append(model.score(n))
            if n.gap and k:
                s = model.edges.get(edge_type(ns[k - 1], n), 0.5)
                i.append(base + k - 1)
                j.append(base + k)
                a.append(s)
            if len(n.fold) >= 4:  # same or similar word: each occurrence with the one before, a chain and no clique
                key = code(n.fold)
                if key in last:
                    i.append(base + last[key])
                    j.append(base + k)
                    a.append(model.edges.get("skip", 1.0))
                last[key] = k
        base += len(ns)
    return np.array(h), np.array(i, np.int64), np.array(j, np.int64), np.array(a)


def beliefs(h: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Log-odds of every node after loopy message passing with potentials that favour equal labels by ``a``. The number of rounds is
    fixed, so that a document's result does not depend on what else is in its batch."""
    if not len(i):
        return h
    src, dst, w = np.r_[i, j], np.r_[j, i], np.r_[a, a]
    back = np.r_[np.arange(len(i)) + len(i), np.arange(len(i))]
    m = np.zeros(len(src))
    for _ in range(rounds):
        total = h + np.bincount(dst, m, len(h))
        x = np.clip(total[src] - m[back], -30, 30)
        new = np.logaddexp(x + w, 0) - np.logaddexp(x, w)
        m = damping * m + (1 - damping) * new
    return h + np.bincount(dst, m, len(h))


def names(texts: list[str], taken: list[list[tuple[str, int, int]]], model: Model) -> list[list[tuple[int, int]]]:
    """Spans of the names of private persons in each text."""
    docs = [nodes(t, s) if t else [] for t, s in zip(texts, taken, strict=True)]
    odds = beliefs(*graph(docs, model))
    out, base = [], 0
    for text, ns in zip(texts, docs, strict=True):
        yes = odds[base : base + len(ns)] > 0
        base += len(ns)
        out.append(_spans(text, ns, yes))
    return out


def _spans(text: str, ns: list[Node], yes: np.ndarray) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    k = 0
    while k < len(ns):
        if not yes[k] or ns[k].shape == "I" and not (k + 1 < len(ns) and yes[k + 1] and ns[k + 1].gap == "blank"):
            k += 1
            continue
        if ns[k].shape == "T" and ns[k].start_of_sentence and k + 1 < len(ns) and yes[k + 1] and ns[k + 1].gap == "blank" and ns[k + 1].shape == "U":
            k += 1  # the word that opens the sentence before a name in capitals
            continue
        e, comma = k, False
        while e + 1 < len(ns) and yes[e + 1]:
            n = ns[e + 1]
            if n.gap == "comma":
                # surname, given names: once only, in one style of capitals
                if comma or ns[e].shape != n.shape and "I" not in (ns[e].shape, n.shape) and (ns[e].shape, n.shape) != ("U", "T"):
                    break
                comma = True
            elif n.gap != "blank":
                break
            e += 1
        end = ns[e].end + (ns[e].shape == "I" and text[ns[e].end : ns[e].end + 1] == ".")
        heading = text[end : end + 1] == ":" and text[ns[k].start : end].isupper()
        if any(ns[x].shape != "I" and ns[x].fold not in LINKS and ns[x].fold != "para" for x in range(k, e + 1)) and not heading:
            spans.append((ns[k].start, end))
        k = e + 1
    return spans


# --- labels by surroundings, for training only


YES_LEFT = re.compile(
    r"(?:comparece|present[oó]se|llamarse|declararon|c[ií]tese\s+a|notif[ií]quese\s+a|c[eé]dula\s+a|fue\s+intimado|perteneciente\s+a|titularidad\s+de|la\s+constancia\s+de|convive\s+con|ocupado\s+por|como\s+garante"
    r"|herman[oa],|el\s+testigo|el\s+sr\.|la\s+sra\.|se\s+lee:|fdo\.:|se\s+presenta|consta\s+que)\s*$",
    re.I,
)
NO_LEFT = re.compile(r"(?:\bdra?\.|nacido\s+en|resid[ií]an\s+en|entregada\s+en|conf\.|\bcfr\.|enseña|poder|juzgado\s+de)\s*$", re.I)
NO_RIGHT = re.compile(r"\s*(?:,?\s*ob\.\s*cit|en\s+su\s+tratado|lo\s+hizo\s+su\s+letrado)", re.I)
CAPTION = re.compile(r"(?:\A|\n)EXPTE\.[^\n]*\n(.{5,200}?)\s+s/", re.S)


def labels(text: str, ns: list[Node]) -> list[int]:
    """1 person, 0 other, -1 unknown, by surroundings."""
    out = [-1] * len(ns)
    index = {id(n): k for k, n in enumerate(ns)}
    runs = _groups(ns)
    for r, run in enumerate(runs):
        left, right = text[max(0, run[0].start - 40) : run[0].start], text[run[-1].end : run[-1].end + 40]
        folds = {n.fold for n in run}
        if folds & ORG or LEGAL.match(right) or NO_LEFT.search(left) or NO_RIGHT.match(right):
            value = 0
        elif YES_LEFT.search(left) or re.search(r"seg[uú]n\s*$", left, re.I) and re.match(r",\s+las\s+llamadas", right):
            value = 1
        else:
            value = -1
        for n in run:
            out[index[id(n)]] = value
        if value == -1 and len(run) > 1 and run[0].start_of_sentence and run[0].shape == "T":  # a sentence that opens with the cue
            cue = text[max(0, run[0].start - 40) : run[1].start]
            if YES_LEFT.search(cue) or re.search(r"seg[uú]n\s*$", cue, re.I) and re.match(r",\s+las\s+llamadas", right):
                value = 1
                for n in run:
                    out[index[id(n)]] = int(n is not run[0])
        if value == 1 and r + 1 < len(runs) and runs[r + 1][0].gap == "comma" and runs[r + 1][0].shape == run[-1].shape == "U":
            for n in runs[r + 1]:
                out[index[id(n)]] = 1
        if value == -1 and run[0].gap == "comma" and r and out[index[id(runs[r - 1][0])]] == 1 and run[0].shape == "U":
            for n in run:
                out[index[id(n)]] = 1
    if m := CAPTION.search(text):
        sides = re.split(r"\s(?:[cC]/|contra)\s", m.group(1))
        at = m.start(1)
        for side in sides:
            a = text.find(side, at)
            inside = [k for k, n in enumerate(ns) if a <= n.start < a + len(side)]
            value = 0 if any(ns[k].fold in ORG for k in inside) or LEGAL.search(side) else 1
            for k in inside:
                out[k] = value
            at = a + len(side)
    for k, n in enumerate(ns):
        if out[k] == -1 and n.start_of_sentence and n.twin or n.fold in ("y", "firmado", "fdo", "contacto", "ver"):
            out[k] = 0
    return out


def fit(labelled: list[tuple[list[str], int]], edges: dict[str, float], ordinary: frozenset[str], least: int = FEW, epochs: int = 12) -> Model:
    """Logistic regression of the node labels by AdaGrad; features seen fewer than ``least`` times are left out, and words that are not
    ``ordinary`` (never written in small letters)."""
    labelled = [([f for f in fs if f[:2] != "w=" or f[2:] in ordinary], y) for fs, y in labelled]
    count: dict[str, int] = defaultdict(int)
    for fs, _ in labelled:
        for f in fs:
            count[f] += 1
    ids = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= least))}
    rows = [(np.array([ids[f] for f in fs if f in ids]), y) for fs, y in labelled]
    w, g2 = np.zeros(len(ids)), np.full(len(ids), 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x, y = rows[k]
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(), -30, 30)))
            g = (p - y) + 1e-3 * w[x]
            g2[x] += g * g
            w[x] -= 0.2 * g / np.sqrt(g2[x])
    return Model({f: round(float(w[k]), 3) for f, k in ids.items() if abs(w[k]) >= 0.05}, edges)
