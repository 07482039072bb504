"""Problem 4: variant spellings of the parties of a folder.

Method: names are blocked by phonetic codes of their sorted tokens (the code of one token with the head or the tail of
another, so that one damaged token still leaves a common block), compared with Jaro-Winkler and edit distance per token plus
a nickname table, and accepted pairs are clustered by connected components.

Equal normalised names of a folder are one node before any pair is formed, so copies cost nothing; only the pairs that the
result asks for are expanded, at the end. Blocks are keys of a shuffle join, never a collected group.

Defined results: a null, empty or wordless name has no link; a null folder is no folder; a single-word person links only to equal
spellings; titles, endings ("y otros"), legal forms, case, accents, blanks and order of parts do not count; relatives (other
given names) and firms that share only a part of their name are different; repeated rows are one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, ensure_checkpoint_dir, fold, spread

#: Titles, legal forms, kinds of organisations with their abbreviations, and nicknames.
TITLES = frozenset("sr sra srta sres dr dra dres lic ing arq prof don dona dn dna cdor cra esc abog mr mrs ms".split())
KINDS = {
    "aseg": "aseguradora", "bco": "banco", "cia": "compania", "constr": "constructora", "coop": "cooperativa", "estab": "establecimientos", "hnos": "hermanos", "ind": "industrias",
    "lab": "laboratorios", "mun": "municipalidad", "transp": "transportes", "inst": "instituto", "fund": "fundacion", "asoc": "asociacion", "univ": "universidad", "min": "ministerio", "prov": "provincia",
}
KIND_WORDS = tuple(sorted(set(KINDS.values()) | {"clinica", "sanatorio", "hospital", "empresa", "consorcio", "sindicato", "obra", "estado", "comercial"}))
FORM_WORDS = ("sociedad", "anonima", "limitada", "ltda", "soc", "resp", "responsabilidad")
FORM = re.compile(r"\b(?:s\W{0,2}r\W{0,2}l|s\W{0,2}a\W{0,2}s|s\W{0,2}a|s\W{0,2}c|s\W{0,2}h|s\W{0,2}e)\b\.?|\bsoc\w*\.? (?:de )?resp\w*\.? (?:ltda|limitada)\b\.?|\bsociedad an\w+\b|\bltda\b\.?|\blimitada\b")
STRONG_FORM = re.compile(r"\bs\W{0,2}r\W{0,2}l\b|\bltda\b|\blimitada\b|\bsociedad an|\bsoc\w*\.? (?:de )?resp")
ENDING = re.compile(r"\by otr[oa]s?\b.*$|\be hij[oa]s?\b.*$")
NICKNAMES = {
    "ale": "alejandra", "andy": "andres", "beto": "alberto", "bety": "beatriz", "betty": "beatriz", "bea": "beatriz", "ceci": "cecilia", "charo": "rosario", "chela": "graciela", "grace": "graciela",
    "coco": "jorge", "dani": "daniel", "edu": "eduardo", "fede": "federico", "fer": "fernando", "nando": "fernando", "fran": "francisco", "pancho": "francisco", "paco": "francisco", "guille": "guillermo",
    "juancho": "juan", "juani": "juan", "lauri": "laura", "lola": "dolores", "lucho": "luis", "luchi": "lucia", "lu": "lucia", "lupe": "guadalupe", "maru": "maria", "mati": "matias", "menchu": "carmen",
    "moni": "monica", "nacho": "ignacio", "nati": "natalia", "pato": "patricia", "pati": "patricia", "pepe": "jose", "quique": "enrique", "kike": "enrique", "rulo": "raul", "santi": "santiago", "silvi": "silvia",
    "susi": "susana", "su": "susana", "tito": "hector", "toto": "antonio", "tony": "antonio", "tommy": "tomas", "tomy": "tomas", "vero": "veronica", "teby": "esteban", "nico": "nicolas", "seba": "sebastian",
}
#: A nickname of two given names is written with the one above; these are its others.
ALSO = {"alberto": ("roberto", "norberto", "humberto"), "alejandra": ("alejandro",), "hector": ("roberto", "ernesto"), "patricia": ("patricio",)}
#: Given names told apart where no comma shows which part is the surname (fixed values; the full forms of the nicknames are added).
GIVEN = frozenset(NICKNAMES.values()) | frozenset(
    """maria mario jose josefa juan juana luis luisa carlos carla carlo ana rosa elena pedro pablo paula miguel angel angela raul oscar hugo marta norma silvia silvio susana laura lauro sofia
    martin martina diego jorge alberto roberto roberta ricardo eduardo ines esteban walter nestor bruno bruna gustavo claudia claudio adriana adrian andrea andres marcela marcelo teresa
    julia julio cesar ramon ramona daniel daniela gabriel gabriela victor victoria emilio emilia fernando fernanda lucio lucia franco franca mariano mariana cecilia cecilio""".split()
)
LINKS = frozenset("de del la las los el da do dos das von van di".split())


@lru_cache(100_000)
def code(token: str) -> str:
    """Spanish phonetic code of a folded token."""
    t = token
    for pattern, to in ((r"qu(?=[ei])", "k"), (r"g(?=[ei])", "j"), (r"gu(?=[ei])", "g"), (r"c(?=[ei])", "s"), ("ch", "x"), ("ll", "i"), ("h", ""), ("[ckq]", "k"), ("z", "s"), ("[vw]", "b"), ("y", "i"), (r"(.)\1+", r"\1")):
        t = re.sub(pattern, to, t)
    return t


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with neighbouring swaps, up to ``most`` + 1; only places at most that far apart are compared, so time is linear."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far, n = most + 1, len(b)
    two: dict[int, int] = {}
    one = {j: j for j in range(min(n, most) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            d = min(one.get(j, far) + 1, row.get(j - 1, far) + 1, one.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two.get(j - 2, far) + 1)
            row[j] = d
        if min(row.values(), default=far) > most:
            return far
        two, one = one, row
    return min(one.get(n, far), far)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [y for y, u in zip(b, used, strict=True) if u]
    t = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    head = 0
    while head < min(4, len(a), len(b)) and a[head] == b[head]:
        head += 1
    return jaro + head * 0.1 * (1 - jaro)


@lru_cache(200_000)
def alike(a: str, b: str) -> float:
    """Likeness of two tokens: 1 equal, 0.95 by sound or nickname, down to 0.8 by spelling; 0 when they differ."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    if code(a) == code(b) or b in ALSO.get(a, ()) or a in ALSO.get(b, ()):
        return 0.95
    d = edits(a, b)
    n = min(len(a), len(b))
    if d == 1 and n >= 3 and jaro_winkler(a, b) >= 0.75 or d == 2 and n >= 6 and jaro_winkler(a, b) >= 0.8 and (a[-3:] == b[-3:] or edits(code(a), code(b)) <= 1):
        return 0.8
    return 0.0


def other_gender(a: str, b: str) -> bool:
    """Whether two given names differ by what tells a man's name from a woman's: a final vowel more, or another one."""
    if len(a) > len(b):
        a, b = b, a
    return len(a) > 2 and (len(b) == len(a) + 1 and b[:-1] == a and b[-1] in "ao" and b[-1] != a[-1] or len(a) == len(b) and a[:-1] == b[:-1] and a[-1] + b[-1] in ("ao", "oa", "ae", "ea", "oe", "eo"))


@lru_cache(50_000)
def _kind_of(token: str) -> str | None:
    if token in KINDS:
        return KINDS[token]
    if token in KIND_WORDS:
        return token
    return next((k for k in KIND_WORDS if len(token) >= 5 and edits(token, k, 1) == 1), None)


@lru_cache(200_000)
def parse(name: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """(kind of organisation or "", tokens, tokens before a comma) of a name; tokens are folded, nicknames resolved."""
    raw = re.sub(r"\s+", " ", fold(name.replace("Ñ", "N").replace("ñ", "n"))).strip(" .,;:-")
    raw = ENDING.sub("", raw)
    # two dotted letters may be initials of a person: they count as a legal form beside a kind of organisation or an acronym
    some_kind = any(_kind_of(t) for t in re.findall(r"[^\W_]+", raw))
    bare = FORM.sub(" ", raw)
    if not (some_kind or STRONG_FORM.search(raw) or re.fullmatch(r"\s*\w{2,5}\s*", bare)):
        bare = raw
    legal = bare != raw
    head, comma, tail = bare.partition(",")

    def split(part: str) -> list[str]:
        return [t for t in re.findall(r"[^\W_]+", part) if t not in TITLES]

    before, tokens = split(head), split(head) + split(tail)
    kind = next((k for t in tokens if (k := _kind_of(t))), "")
    if kind:
        core = [t for t in tokens if _kind_of(t) != kind and t not in FORM_WORDS and not any(len(t) > 5 and edits(t, w, 1) <= 1 for w in FORM_WORDS)]
        core = [t for t in core if t not in ("de",)]
        return kind, tuple(core), ()
    if len(tokens) == 1 and not comma and 2 <= len(tokens[0]) <= 6 and tokens[0].upper() in name and tokens[0] not in NICKNAMES:
        return "sigla", tuple(tokens), ()
    if legal and not comma:
        return "firma", tuple(t for t in tokens if t not in ("de",)), ()
    tokens = [NICKNAMES.get(t, t) for t in tokens]
    return "", tuple(tokens), tuple(NICKNAMES.get(t, t) for t in before) if comma else ()


@lru_cache(200_000)
def legal_form(name: str) -> str:
    m = FORM.search(fold(name))
    if not m:
        return ""
    x = re.sub(r"[^a-z]", "", m.group())
    return "srl" if "resp" in x or x == "srl" else "ltda" if x[:1] == "l" else "sa" if x.startswith(("sociedad", "sa")) else x


def initials(kind: str, tokens: tuple[str, ...]) -> str:
    return kind[:1] + "".join(t[0] for t in tokens if t not in LINKS)


def _align(few: tuple[str, ...], many: tuple[str, ...], surnames: frozenset[str] | None = frozenset()) -> list[float] | None:
    """Likeness of each token of the shorter name with its partner in the longer one; None if one has no partner.

    Equal initials count as initials: they prove no more than an initial beside a full word. ``surnames``: tokens known to be such;
    given names of another gender have no likeness (relatives). None: no persons.
    """

    def near(t: str, x: str) -> float:
        if surnames is not None and t != x and other_gender(t, x) and not (t in surnames and x in surnames):
            if t in GIVEN or x in GIVEN or surnames and t not in surnames and x not in surnames:
                return 0.0
        return alike(t, x)

    free, out = list(many), []
    for t in sorted(few, key=lambda x: -len(x)):
        best = max(free, key=lambda x: (near(t, x), len(x)), default=None)
        if best is None or not near(t, best):
            return None
        free.remove(best)
        out.append(min(0.6, near(t, best)) if len(t) == 1 else near(t, best))
    return out


def same_party(a: str, b: str) -> bool:
    """Whether two names mean one person or organisation."""
    ka, ta, sa = parse(a)
    kb, tb, sb = parse(b)
    if not ta or not tb or bool(ka) != bool(kb):
        return False
    if ka:
        if (ka == "sigla") != (kb == "sigla"):  # an acronym stands for kind and words in their order, under the same legal form
            short, long, k, other = (ta[0], tb, kb, b) if ka == "sigla" else (tb[0], ta, ka, a)
            forms = {legal_form(a), legal_form(b)} - {""}
            return k != "firma" and short == initials(k, long) and len(forms) < 2
        if ka == kb == "sigla":
            return ta == tb
        if ka != kb and "firma" not in (ka, kb):
            return False
        if len(ta) != len(tb):
            return "".join(sorted("".join(ta))) == "".join(sorted("".join(tb))) if ka == kb else False
        got = _align(ta, tb, None)
        return got is not None and min(got) >= 0.8 and sum(x < 0.95 for x in got) <= 2
    few, many, sf, sm = (ta, tb, sa, sb) if len(ta) <= len(tb) else (tb, ta, sb, sa)
    few, many = tuple(t for t in few if t not in LINKS), tuple(t for t in many if t not in LINKS)
    if len(few) < 2:
        return len(few) == len(many) == 1 and code(few[0]) == code(many[0])
    got = _align(few, many, frozenset(sa) | frozenset(sb))
    if got is None or sum(0.6 < x < 0.9 for x in got) > 2 or sum(x > 0.6 for x in got) < 1:
        return False
    if sf and sm:  # both say which part is the surname: the first surnames must agree, and the first given names
        gf, gm = tuple(t for t in ta[len(sa) :]), tuple(t for t in tb[len(sb) :])
        if not alike(sa[0], sb[0]) or gf and gm and not alike(gf[0], gm[0]):
            return False
    return max(got) > 0.6


def keys(folder: str, name: str) -> list[int]:
    """Block keys of a name within its folder."""
    kind, tokens, _ = parse(name)
    tokens = tuple(sorted({t for t in tokens if t not in LINKS}))
    codes = [code(t) for t in tokens]
    out = {f"={' '.join(codes)}"}
    for i, a in enumerate(codes):
        if len(tokens[i]) < 2:
            continue
        for j, b in enumerate(codes):
            if i != j:
                out |= {f"h{kind and 'o'}{a}|{x[0]}" for x in (tokens[j], *ALSO.get(tokens[j], ()))}
                if len(a) > 4:
                    out |= {f"m{kind and 'o'}{a[:2]}{a[-2:]}|{tokens[j][0]}", f"n{kind and 'o'}{a[-5:]}|{tokens[j][0]}"}
                if len(b) > 3:
                    out.add(f"t{kind and 'o'}{a}|{b[-3:]}")
    long = [c for c in codes if len(c) > 2]
    for cut in (slice(0, 3), slice(-3, None)):
        ends = sorted(c[cut] for c in long)
        out |= {f"p{x}|{y}" for k, x in enumerate(ends) for y in ends[k + 1 :]}
    if kind == "sigla":
        out = {f"a{tokens[0]}"}
    elif kind:
        out.add("a" + initials(kind, parse(name)[1]))
        out |= {f"s{kind}{c[:3]}" for c in codes} | {f"e{kind}{c[-3:]}" for c in codes}
    return [xxhash.xxh64_intdigest(f"{folder}\0{k}") - (1 << 63) for k in sorted(out)]


#: Blocks and components of more rows than HOT are split over SALTS tasks each.
HOT, SALTS = 400, 32


def self_pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    """a < b of every two items of a key. The rows of a large key meet each other in SALTS tasks, each with a part of the left side."""
    left, right = rows.select(key, F.col(item).alias("a")), rows.select(key, F.col(item).alias("b"))
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(key, F.lit(True).alias("large")).checkpoint()
    if large.isEmpty():
        return left.join(right, key).where("a < b").select("a", "b")
    one = F.when(F.col("large"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("large"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(large, key, "left").select(key, "a", one.alias("salt"))
    right = right.join(large, key, "left").select(key, "b", F.explode(every).alias("salt"))
    return left.join(right, [key, "salt"]).where("a < b").select("a", "b")


def components(edges: DataFrame, vertices: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component (smallest id) of every vertex; hash-to-minimum with a reliable checkpoint of every round.

    Labels jump to the label of their label, so rounds grow with the logarithm of the longest chain; not settled after ``rounds`` is an error."""
    edges = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = vertices.select("id", F.col("id").alias("component"))
    for _ in range(rounds):
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        stepped = labels.join(near, labels.id == near.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = stepped.select(F.col("id").alias("j"), F.col("component").alias("far"))
        new = stepped.join(jump, stepped.component == jump.j).select("id", F.col("far").alias("component"), "old").checkpoint()
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")


def linked(parties: DataFrame) -> DataFrame:
    """party_id, folder, component, n_links: every party with a name, its cluster and its number of links to other spellings."""
    spark = parties.sparkSession
    ensure_checkpoint_dir(spark)
    rows = parties.where(F.col("nombre").isNotNull() & F.col("folder").isNotNull()).select("party_id", "folder", "nombre").dropDuplicates(["party_id"])
    # one node for each exact spelling of a folder
    nodes = rows.groupBy("folder", "nombre").agg(F.min("party_id").alias("id"))

    def block(rows) -> Iterator[tuple]:
        for i, folder, name in rows:
            for k in keys(folder, name) if parse(name)[1] else ():
                yield k, i

    # blocks and pairs carry ids only; the spellings join the distinct pairs
    blocks = arrow_rows(spread(nodes.select("id", "folder", "nombre"), "id"), "k bigint, id bigint", block).checkpoint()
    candidates = self_pairs(blocks, "k", "id").distinct()
    spelt = candidates.join(nodes.select(F.col("id").alias("a"), F.col("nombre").alias("na")), "a").join(nodes.select(F.col("id").alias("b"), F.col("nombre").alias("nb")), "b")

    def compare(rows) -> Iterator[tuple]:
        for a, b, na, nb in rows:
            if same_party(na, nb):
                yield a, b

    edges = arrow_rows(spelt.select("a", "b", "na", "nb"), "a bigint, b bigint", compare, 4096).checkpoint()
    degree = edges.select("a").unionAll(edges.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"))
    found = components(edges, degree.select("id")).join(degree, "id")  # a spelling without links is its own component
    named = nodes.join(found, "id", "left").select("folder", "nombre", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(named, ["folder", "nombre"]).select("party_id", "folder", "component", "n_links")


def pairs(parties: DataFrame) -> DataFrame:
    """party_id_a, party_id_b of every two parties of one cluster."""
    return self_pairs(linked(parties).select("party_id", "component").checkpoint(), "component", "party_id").select(F.col("a").alias("party_id_a"), F.col("b").alias("party_id_b"))
