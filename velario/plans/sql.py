"""The SQL (DuckDB) of the queries that SQL can express, over the same tables. Patterns are written for its own regex dialect."""

from __future__ import annotations

#: Blanks beyond ASCII, and digits of any script, in that dialect.
S = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}]"
D = r"\p{Nd}"
L = r"[\p{L}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"

DOCS = """docs AS (
  SELECT doc_id, format, path, text, page_count FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM (
      SELECT doc_id, 'pdf' AS format, path, full_text AS text, page_count, loaded_at FROM pdf_documents
      UNION ALL SELECT doc_id, 'docx', path, full_text, 0, loaded_at FROM docx_documents)) WHERE rn = 1)"""
AUDITS = "au AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM audits) WHERE rn = 1)"
PARTIES = "pa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY party_id) AS rn FROM audit_parties) WHERE rn = 1)"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def found(pattern: str, group: int = 0, source: str = "docs", column: str = "text", name: str = "f") -> str:
    """CTEs giving doc_id, i, s (0-based start of the match), m (match), g (group) of all matches of a pattern."""
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all({column}, {q(pattern)}, 0) AS ms, regexp_extract_all({column}, {q(pattern)}, {group}) AS gs,
  string_split_regex({column}, {q(pattern)}) AS ps FROM {source} WHERE {column} IS NOT NULL),
{name}_i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_m WHERE len(ms) > 0),
{name} AS (SELECT doc_id, i, ms[i] AS m, gs[i] AS g, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS s FROM {name}_i)"""


def weighted(x: str, first: int, weights: tuple[int, ...]) -> str:
    return " + ".join(f"CAST(substr({x}, {first + k}, 1) AS INT) * {w}" for k, w in enumerate(weights))


CUIT = weighted("n", 1, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2))
BANK = weighted("n", 1, (7, 1, 3, 9, 7, 1, 3))
ACCOUNT = weighted("n", 9, (3, 9, 7, 1, 3, 9, 7, 1, 3, 9, 7, 1, 3))

DNI = rf"(?i)(?:DNI|D\.N\.I\.?|D\. ?N\. ?I\.?|L\.?E\.?|L\.?C\.?|documento(?:{S}+de{S}+identidad)?)(?:{S}|[:N°º.])*({D}{{1,2}}\.?{D}{{3}}\.?{D}{{3}})\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = rf"(?i)(?:tel[eé]fono|tel\.?|celular|cel\.?|m[oó]vil|fax)(?:{S}|[:N°º.])*((?:\+?54(?:{S}|-)?)?(?:\(?{D}{{2,4}}\)?(?:{S}|-)?)?{D}{{3,4}}(?:{S}|-)?{D}{{4}})"
BODY = rf"(?im)^{S}*(?:Y{S}+VISTOS?|VISTO|RESULTA|RESULTANDO|I{S}*[.\-]{S}*DEMANDA|I{S}*[.\-]{S}*ANTECEDENTES|AUTOS{S}+Y{S}+VISTOS|CONSIDERANDO){S}*[:.]"
SIGNATURE = rf"(?i)(?:PROTOCOL[IÍ]CESE|Es{S}+copia(?:{S}+fiel)?|Texto{S}+Firmado{S}+digitalmente{S}+por|Firmado(?:{S}+digitalmente)?{S}*:|Notif[ií]quese{S}+y{S}+arch[ií]vese|REG[IÍ]STRESE{S}+Y{S}+NOTIF[IÍ]QUESE)"
COURTS = rf"(?i)(?:CSJN(?:,|{S})|Fallos:{S}*{D}+|CNCiv\.|CNCom\.|CNCrim\.|CNCAF\.|TSJ{S}+{L}+|C[aá]m\.{S}*(?:Civ|Com|Crim|Apel)|C\.{S}*Nac\.{S}*(?:Civ|Com|Crim))"
DOCTRINE = rf"(?i)(?:ver{S}+doctrina{S}+de{S}+|conf\.{S}+|cf(?:r)?\.{S}+|seg[uú]n{S}+ense[ñn]a{S}+|en{S}+palabras{S}+de{S}+)"


def windows(pattern: str, name: str, role: str, window: int, least: int) -> str:
    return f"""WITH {DOCS}, {found(pattern)},
w AS (SELECT f.doc_id, s, least(s + {window}, length(text)) AS e, text FROM f JOIN docs USING (doc_id)),
p AS (SELECT *, instr(substr(text, s + {least} + 1, greatest(e - s - {least}, 0)), '. ') AS k FROM w)
SELECT doc_id, '{name}' AS name, s AS char_start, CAST(CASE WHEN k > 0 THEN s + {least} + k ELSE e END AS INT) AS char_end, '{role}' AS default_role FROM p"""


CAPTION_ROWS = f"""SELECT doc_id, 'CARATULA' AS name, 0 AS s, CAST(CASE WHEN len(ps) > 1 THEN length(ps[1]) ELSE least(800, length(text)) END AS INT) AS e, 'PARTE' AS default_role
  FROM (SELECT doc_id, text, string_split_regex(text, {q(BODY)}) AS ps FROM docs WHERE text IS NOT NULL)"""
SIGNATURE_ROWS = f"""SELECT f.doc_id, 'FIRMA' AS name, f.s, CAST(length(text) AS INT) AS e, 'JUEZ' AS default_role FROM (SELECT doc_id, max(s) AS s FROM f GROUP BY doc_id) f JOIN docs USING (doc_id)
  WHERE NOT (length(text) > 300 AND f.s < floor(length(text) * 0.7))"""

ROLE = """CASE WHEN lower(rol) IN ('actor', 'actora') THEN 'PARTE_ACTORA' WHEN lower(rol) IN ('demandado', 'demandada') THEN 'PARTE_DEMANDADA' WHEN lower(rol) = 'tercero' THEN 'TERCERO_CITADO'
  WHEN lower(rol) = 'testigo' THEN 'TESTIGO' ELSE 'DESCONOCIDO' END"""
PREFIXES = "(VALUES ('PARTE_ACTORA', 'ACTOR'), ('PARTE_DEMANDADA', 'DEMANDADO'), ('TERCERO_CITADO', 'TERCERO'), ('TESTIGO', 'TESTIGO'), ('DESCONOCIDO', 'PERSONA')) AS px(role, prefix)"
COMPANY = "(?:COOPERATIVA|MUNICIPALIDAD|GOBIERNO|PROVINCIA|ESTADO|BANCO|EMPRESA|ASOCIACIÓN|ASOCIACION|FUNDACIÓN|FUNDACION|MUTUAL|SINDICATO|FEDERACIÓN|FEDERACION|MINISTERIO)"

MENTIONS = f"""{AUDITS}, {PARTIES},
mentions AS (SELECT au.doc_id, pa.seq AS card_id, nombre AS text, {ROLE} AS role, 1.0 - (pa.seq * 7 % 10) / 100.0 AS confidence FROM pa JOIN au USING (audit_id)
  WHERE nombre IS NOT NULL AND trim(nombre) <> ''),
normed AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(trim(text), '(?i)\\b(?:dr|dra|sr|sra|srta|don|do[ñn]a|lic|ing|prof|cdor|cra)\\.?\\s+', '', 'g'))),
  '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM mentions),
keyed AS (SELECT *, coalesce(nullif(list_extract(string_split(norm, ' '), -1), ''), '__singleton_' || card_id) AS key FROM normed),
grouped AS (SELECT doc_id, key, min(card_id) AS first_card, count(*) AS n_mentions, count(DISTINCT role) AS nr, arg_min(role, card_id) AS r1, arg_min(confidence, card_id) AS c1,
  list_extract(list(role ORDER BY confidence DESC, card_id), 1) AS r2, max(confidence) AS c2 FROM keyed GROUP BY doc_id, key),
chosen AS (SELECT doc_id, key, first_card, n_mentions, CASE WHEN nr > 1 THEN r2 ELSE r1 END AS role, CASE WHEN nr > 1 THEN c2 ELSE c1 END AS confidence FROM grouped),
clusters AS (SELECT doc_id, key, c.role, confidence, first_card, n_mentions, '[' || prefix || '_' || row_number() OVER (PARTITION BY doc_id, c.role ORDER BY first_card) || ']' AS placeholder
  FROM chosen c LEFT JOIN {PREFIXES} ON c.role = px.role)"""

METRICS = """dm AS (SELECT audit_id, coalesce(n_pages, 0) AS n_pages, coalesce(text_chars, 0) AS text_chars, coalesce(n_replacements, 0) AS n_replacements, coalesce(replacements_per_page, 0) AS replacements_per_page,
  coalesce(replacements_per_kchar, 0) AS replacements_per_kchar, coalesce(elapsed_s, 0) AS elapsed_s, coalesce(model, '?') AS model, coalesce(len(warnings), 0) > 0 AS has_warnings, coalesce(success, false) AS success FROM au)"""
STEM = "regexp_replace(regexp_extract({0}, '[^/]*$'), '\\.[^.]*$', '')"

QUEUE = f"""rows AS (SELECT {STEM.format('input_path')} AS stem, n_pages, n_replacements, coalesce(len(warnings), 0) > 0 AS has_warnings, output_path, coalesce(np, 0) AS n_parties
  FROM au LEFT JOIN (SELECT audit_id, count(*) AS np FROM pa GROUP BY audit_id) USING (audit_id)),
originals AS (SELECT {STEM.format('path')} AS stem FROM docs)"""
STATUSES = ("pending", "approved", "rejected", "needs_fix")
QUEUED = f"""WITH {DOCS}, {AUDITS}, {PARTIES}, {QUEUE},
state AS (SELECT stem, CASE ascii(right(stem, 1)) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'needs_fix' END AS status FROM rows),
queue AS (SELECT o.stem, CAST(coalesce(n_pages, 0) AS BIGINT) AS n_pages, coalesce(n_replacements, 0) AS n_replacements, n_parties, has_warnings, coalesce(s.status, 'pending') AS status,
  (has_warnings OR coalesce(n_replacements, 0) = 0 OR x.stem IS NULL) AS is_problematic
  FROM originals o JOIN rows r USING (stem) LEFT JOIN (SELECT * FROM state WHERE status IS NOT NULL) s USING (stem) LEFT JOIN (SELECT DISTINCT stem FROM rows WHERE output_path IS NOT NULL) x USING (stem))"""
#: Each ruling at its first delivery.
FIRST_DOCS = DOCS.replace("loaded_at DESC NULLS LAST", "loaded_at NULLS LAST")


#: Rulings beside those of the tables that hold what the tables lack: plates, bank account numbers, cited courts and cases.
PLANTED = (
    (-1, "Se secuestró el rodado dominio AB123CD y la moto ABC 123, no el XYZ12."),
    (-2, "Dominio AB 123 CD; dominio anterior DEF456. CBU 0170035040000002373188 y CBU 0170035040000002373189."),
    (-3, "Conforme CSJN, Fallos: 310:1162, el agravio no prospera. Así lo dijo el TSJ Córdoba en otra causa. Fin."),
    (-4, 'Así "Pérez Juan c/ ANSES s/ jubilación" y "Gómez vs. Banco Central"; no así "sin partes" ni "A c/ B".'),
    (-5, None),
    (-6, ""),
)
PLANTED_ROWS = ", ".join(f"({i}, {'NULL' if t is None else q(t)})" for i, t in PLANTED)


def with_planted(sql: str) -> str:
    """The same SQL over all rulings and the planted ones."""
    more = f", docs AS (SELECT doc_id, text FROM table_docs UNION ALL SELECT * FROM (VALUES {PLANTED_ROWS}) AS v(doc_id, text))"
    return sql.replace(DOCS, DOCS.replace("docs AS", "table_docs AS", 1) + more, 1)


#: Detectors in the order that decides ties, with the type and confidence of what they find.
DETECTORS = (("dni", "DNI", 1.0), ("cuit", "CUIT", 1.0), ("cbu", "CBU", 1.0), ("email", "EMAIL", 1.0), ("phone", "TELEFONO", 0.95), ("plate", "PATENTE", 0.9), ("passport", "PASAPORTE", 0.9))


def resolved(single: dict[str, str], texts: str = "") -> str:
    """CTEs ending in ``spans``: all identifiers of the rulings, without those that a longer one before or over them displaces.

    The sweep keeps a list for each document and looks at one span after another, in order of start, length and detector.
    """
    parts = []
    for k, (name, kind, confidence) in enumerate(DETECTORS):
        sure = "CASE formato WHEN 'viejo' THEN 0.75 ELSE 0.9 END" if name == "plate" else str(confidence)
        parts.append(
            f"SELECT doc_id, char_start AS s, char_end AS e, text, '{kind}' AS type, CAST({sure} AS DOUBLE) AS confidence, {'normalized' if name in ('dni', 'cuit', 'cbu', 'phone') else 'CAST(NULL AS VARCHAR)'} AS normalized, "
            f"{'formato' if name == 'plate' else 'CAST(NULL AS VARCHAR)'} AS formato, {k} AS d FROM ({single[f'{name}_spans']})"
        )
    return f"""WITH RECURSIVE {DOCS}, a AS ({' UNION ALL '.join(parts)}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, s - e, d, coalesce(formato, '')) AS rn FROM a),
sweep(doc_id, rn, kept) AS (
  SELECT doc_id, rn, [struct_pack(s := s, e := e, rn := rn)] FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.rn, CASE WHEN o.s >= w.kept[-1].e THEN list_append(w.kept, struct_pack(s := o.s, e := o.e, rn := o.rn))
    WHEN o.e - o.s > w.kept[-1].e - w.kept[-1].s THEN list_append(w.kept[:-2], struct_pack(s := o.s, e := o.e, rn := o.rn)) ELSE w.kept END
  FROM sweep w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
final AS (SELECT doc_id, unnest(arg_max(kept, rn)).rn AS rn FROM sweep GROUP BY doc_id),
spans AS (SELECT o.* FROM final JOIN o USING (doc_id, rn))"""


REPLACED = """, prefixed AS (SELECT *, CASE type WHEN 'TELEFONO' THEN 'TEL' ELSE type END AS prefix, min(s) OVER (PARTITION BY doc_id, type, text) AS seen FROM spans),
numbered AS (SELECT *, '[' || prefix || '_' || dense_rank() OVER (PARTITION BY doc_id, type ORDER BY seen) || ']' AS ph, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM prefixed),
made AS (SELECT n.doc_id, string_agg(substr(text_, prev + 1, s - prev) || ph, '' ORDER BY s) || substr(any_value(text_), max(e) + 1) AS redacted, count(*) AS n
  FROM numbered n JOIN (SELECT doc_id, text AS text_ FROM docs) t USING (doc_id) GROUP BY n.doc_id)"""

CAPITAL, SMALL = "A-ZÁÉÍÓÚÑ", "a-záéíóúñ"
AUTHOR = rf"^[{CAPITAL}][{SMALL}]+(?:\s+(?:(?:de|del|la|y)\s+)?[{CAPITAL}][{SMALL}]+){{0,3}}"
WORK = rf"\b([{CAPITAL}][{CAPITAL}{SMALL}]+(?:\s+[{CAPITAL}][{SMALL}]+){{0,3}})(?:,\s*[^,]{{0,40}}){{0,3}},\s*(?:19|20)[0-9]{{2}}\b"
TRIGGER = r"(?i)\b(?:ver\s+doctrina\s+de|conf(?:orme)?\.|cfr?\.|seg[uú]n\s+ense[ñn]a|en\s+palabras\s+de)\s+"
CASE_SIDE = r"^(.*?)\s(?:c/|s/|vs\.?)\s(.*)$"


def _letters(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1])), '. ') || '.'"


#: Kinds of words of a caption, one letter each, as the engine tells them; the two sides of a versus mark.
WORD_KIND = r"""CASE WHEN t = chr(10) THEN 'z' WHEN t IN ('c/', 'C/', 'c.', 'C.', 'contra') THEN 'v' WHEN t IN ('de', 'del', 'la', 'las', 'los', 'y', 'e') THEN 'l'
  WHEN regexp_full_match(t, 'S\.A\.?|S\.R\.L\.?|S\.A\.S\.?') THEN 'f' WHEN regexp_full_match(t, '(S\.A\.?|S\.R\.L\.?|S\.A\.S\.?),') THEN 'g'
  WHEN regexp_full_match(t, '([A-ZÁÉÍÓÚÑÜ][LETTERS]+|[A-ZÁÉÍÓÚÑÜ]\.)') THEN 'n' WHEN regexp_full_match(t, '([A-ZÁÉÍÓÚÑÜ][LETTERS]+|[A-ZÁÉÍÓÚÑÜ]\.),') THEN 'k' ELSE 'x' END""".replace(
    "LETTERS", r"\p{L}\p{M}\p{N}_''`´\x{80}-\x{9f}\x{200c}\x{200d}"
)
SIDES = "((n[nl]{0,3})?kn[nl]{0,4})v(n[nlf]{0,5}[kg]n[nlf]{0,4}|kn[nlf]{0,4}|n[nlf]{0,6})"


def _cleaned(x: str) -> str:
    ends = "regexp_replace({0}, '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"
    return ends.format(f"regexp_replace({ends.format(x)}, '(?i)\\s+y(\\s+otr[oa]s?)?$', '')")


CAPTION_PARTIES = f"""WITH {DOCS}, h AS (SELECT doc_id, text, substr(text, 1, CASE WHEN len(ps) > 1 THEN length(ps[1]) ELSE least(1500, length(text)) END) AS head
  FROM (SELECT doc_id, text, string_split_regex(text, {q(BODY)}) AS ps FROM docs WHERE text IS NOT NULL AND text <> '')),
p AS (SELECT *, regexp_replace(regexp_replace(head, '([ \\t])([cC]/|[cC]\\.)([^\\s])', '\\1\\2 \\3', 'g'), '(^|\\s)([^\\s\\p{{L}}\\p{{N}}•·]+)(\\p{{L}})', '\\1\\2 \\3', 'g') AS parted FROM h),
w AS (SELECT doc_id, text, head, regexp_extract_all(parted, '\\n|[^\\s\\x{{85}}\\p{{Z}}•·]+|[\\x{{0b}}-\\x{{0d}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') AS ts FROM p),
k AS (SELECT *, array_to_string(list_transform(ts, lambda t: {WORD_KIND}), '') AS ks FROM w),
m AS (SELECT doc_id, text, head, ts, regexp_extract_all(ks, '{SIDES}', 1) AS a, regexp_extract_all(ks, '{SIDES}', 3) AS b, regexp_extract_all(ks, '{SIDES}') AS ms, string_split_regex(ks, '{SIDES}') AS gaps FROM k),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
pl AS (SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS s FROM i),
n AS (SELECT doc_id, text, head, i, 1 AS side, 'PARTE_ACTORA' AS role_hint, {_cleaned("array_to_string(ts[s + 1:s + length(a[i])], ' ')")} AS name FROM pl
  UNION ALL SELECT doc_id, text, head, i, 2, 'PARTE_DEMANDADA', {_cleaned("array_to_string(ts[s + length(ms[i]) - length(b[i]) + 1:s + length(ms[i])], ' ')")} FROM pl),
g AS (SELECT *, contains(text, name) AS exact FROM n WHERE length(name) >= 4),
pieces AS (SELECT *, CASE WHEN exact THEN string_split(text, name) ELSE string_split(lower(head), lower(name)) END AS ps FROM g),
o AS (SELECT *, unnest(range(1, len(ps))) AS j FROM pieces)
SELECT doc_id, CAST(list_sum(list_transform(ps[1:j], lambda x: length(x))) + (j - 1) * length(name) AS INT) AS char_start,
  CAST(list_sum(list_transform(ps[1:j], lambda x: length(x))) + j * length(name) AS INT) AS char_end,
  substr(text, CAST(list_sum(list_transform(ps[1:j], lambda x: length(x))) + (j - 1) * length(name) + 1 AS BIGINT), length(name)) AS text, role_hint FROM o"""

INITIALS = f"""WITH {PARTIES}, n AS (SELECT party_id, trim(nombre) AS n FROM pa WHERE nombre IS NOT NULL),
f AS (SELECT *, regexp_extract(upper(n), '(?:^|[ ,.;])(S\\.A\\.C\\.I\\.F\\.|S\\.A\\.C\\.I\\.|S\\.R\\.L\\.|S\\.A\\.S\\.|SACIF|SACI|S\\.A\\.|S\\.C\\.|S\\.H\\.|S\\.E\\.|SRL|SAS|SA|SC|SH|SE)$', 1) AS form FROM n),
b AS (SELECT *, trim(substr(n, 1, length(n) - length(form))) AS base, trim(string_split(n, ',')[1]) AS surname, trim(regexp_replace(n, '^[^,]*,', '')) AS given, contains(n, ',') AS comma FROM f)
SELECT party_id, CASE WHEN n = '' THEN n WHEN form <> '' AND base = '' THEN n
  WHEN form <> '' THEN {_letters('base')} || ' ' || regexp_replace(replace(form, '.', ''), '(.)', '\\1.', 'g')
  WHEN NOT comma THEN {_letters('n')} WHEN given = '' THEN {_letters('surname')} ELSE {_letters('surname')} || ', ' || {_letters('given')} END AS initials FROM b"""


def all_spans(single: dict[str, str], more: dict[str, str]) -> str:
    """CTEs ending in ``kept``: the resolved identifiers, cited authors and cases, and caption parties, resolved once more by source."""
    return f"""{resolved(single)},
u AS (SELECT doc_id, s, e, text, type, 'regex' AS source, 100 AS prio, 0 AS d, 0 AS k FROM spans
  UNION ALL SELECT doc_id, char_start, char_end, text, type, 'structure', 80, 1, 0 FROM ({more["doctrine_authors"]})
  UNION ALL SELECT doc_id, char_start, char_end, text, type, 'structure', 80, 2, 0 FROM ({more["case_names"]})
  UNION ALL SELECT doc_id, char_start, char_end, text, 'PER', 'structure', 80, 3, 0 FROM ({more["caption_parties"]})),
uo AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, -prio, s - e, d) AS rn FROM u),
again(doc_id, rn, kept) AS (
  SELECT doc_id, rn, [struct_pack(s := s, e := e, p := prio, rn := rn)] FROM uo WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.rn, CASE WHEN o.s >= w.kept[-1].e THEN list_append(w.kept, struct_pack(s := o.s, e := o.e, p := o.prio, rn := o.rn))
    WHEN o.prio > w.kept[-1].p OR o.prio = w.kept[-1].p AND o.e - o.s > w.kept[-1].e - w.kept[-1].s THEN list_append(w.kept[:-2], struct_pack(s := o.s, e := o.e, p := o.prio, rn := o.rn)) ELSE w.kept END
  FROM again w JOIN uo o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
kept AS (SELECT uo.* FROM (SELECT doc_id, unnest(arg_max(kept, rn)).rn AS rn FROM again GROUP BY doc_id) JOIN uo USING (doc_id, rn))"""


def queries() -> dict[str, str]:
    single = plain()
    spans = resolved(single)
    shown = f"{spans}{REPLACED}"
    first = f"(SELECT DISTINCT ON (doc_id) doc_id, loaded_at FROM (SELECT doc_id, loaded_at FROM pdf_documents UNION ALL SELECT doc_id, loaded_at FROM docx_documents) ORDER BY doc_id, loaded_at NULLS LAST)"
    more = {
        "resolved_identifiers": f"{spans} SELECT doc_id, s AS char_start, e AS char_end, text, type, 'regex' AS source, confidence, normalized, formato FROM spans",
        "identifiers_by_type": f"{spans} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY type",
        "identifiers_redacted": f"{shown} SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_spans, coalesce(redacted, text) AS redacted FROM docs LEFT JOIN made USING (doc_id)",
        "stream_redaction": f"{shown} SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_spans, coalesce(redacted, text) AS redacted FROM docs LEFT JOIN made USING (doc_id)",
        "document_zones": " UNION ALL ".join(f"SELECT * FROM ({single[z]})" for z in ("caption_zone", "signature_zone", "jurisprudence_zones", "doctrine_zones")),
        "doctrine_authors": f"""WITH {DOCS}, {found(TRIGGER)}, {found(WORK, 1, name="w")},
t AS (SELECT f.doc_id, CAST(s + length(m) AS INT) AS s, regexp_extract(substr(text, s + length(m) + 1, 80), {q(AUTHOR)}, 0) AS a FROM f JOIN docs USING (doc_id))
SELECT doc_id, s AS char_start, CAST(s + length(a) AS INT) AS char_end, a AS text, 'AUTOR_DOCTRINA' AS type FROM t WHERE length(a) >= 3
UNION ALL SELECT doc_id, s, CAST(s + length(g) AS INT), g, 'AUTOR_DOCTRINA' FROM w""",
        "case_names": f"""WITH {DOCS}, {found('["“]([^"“”]+)["”]', 1)}, c AS (SELECT *, regexp_extract(g, {q("(?s)" + CASE_SIDE)}, ['a', 'b']) AS x FROM f)
SELECT doc_id, CAST(s + 1 AS INT) AS char_start, CAST(s + 1 + length(g) AS INT) AS char_end, g AS text, 'AUTOR_JURISPRUDENCIA' AS type FROM c WHERE length(rtrim(x.a)) BETWEEN 4 AND 120 AND length(x.b) BETWEEN 2 AND 120""",
        "coref_audit": f"""WITH {MENTIONS} SELECT doc_id, key AS cluster_key, c.role, placeholder, CAST(round_even(confidence, 3) AS DOUBLE) AS confidence, n_mentions AS n_menciones,
  (SELECT arg_min(k.text, k.card_id) FROM keyed k WHERE k.doc_id = c.doc_id AND k.key = c.key) AS sample FROM clusters c""",
        "initials": INITIALS,
        "caption_parties": CAPTION_PARTIES,
        "spans_at_points": """WITH b AS (SELECT DISTINCT ON (span_id) doc_id, page, span_id AS ord, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM pdf_spans),
p AS (SELECT doc_id, page, ord AS point_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM b WHERE x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL),
j AS (SELECT p.point_id, round(y1 - y0, 3) AS size, row_number() OVER (PARTITION BY p.point_id ORDER BY abs((y0 + y1) / 2 - y), ord) AS rn FROM p JOIN b USING (doc_id, page)
  WHERE x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2)
SELECT doc_id, page, p.point_id, coalesce(size, 12.0) AS size, 'Times' AS font FROM p LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (point_id)""",
        "parsed_parties": f"WITH {PARTIES} SELECT party_id, trim(nombre) AS nombre, lower(trim(coalesce(rol, 'desconocido'))) AS rol FROM pa WHERE nombre IS NOT NULL AND party_id % 3 < 2",
        "review_queue": f"{QUEUED} SELECT * FROM queue WHERE is_problematic",
        "review_counts": f"""{QUEUED} SELECT count(*) AS "all", CAST(count_if(is_problematic) AS BIGINT) AS problematic, {', '.join(f"CAST(count_if(status = '{x}') AS BIGINT) AS {x}" for x in STATUSES)} FROM queue""",
        "identifier_counts_by_type": f"""{resolved(single).replace(DOCS, FIRST_DOCS)} SELECT date_trunc('day', loaded_at) AS window_start, type, count(*) AS n FROM spans JOIN {first} USING (doc_id) WHERE loaded_at IS NOT NULL GROUP BY ALL""",
    }
    # the same detectors over texts in which the addresses of mail are replaced
    left = resolved(single).replace(DOCS, f"docs AS (SELECT doc_id, redacted AS text FROM ({single['email_redacted']}))")
    more["regex_leaks"] = f"{left} SELECT doc_id, 'REGEX_LEAK' AS code, 'identifier left: ' || type || ' at ' || s AS message FROM spans"
    every = all_spans(single, more)
    more["resolved_spans"] = f"{every} SELECT doc_id, s AS char_start, e AS char_end, text, type, source FROM kept"
    zones = " UNION ALL ".join(f"SELECT *, {k} AS k FROM ({single[z]})" for k, z in enumerate(("caption_zone", "signature_zone", "jurisprudence_zones", "doctrine_zones")))
    more["zones_of_spans"] = f"""{every}, z AS ({zones}),
j AS (SELECT kept.doc_id, kept.s, kept.e, kept.type, z.name, z.default_role, row_number() OVER (PARTITION BY kept.doc_id, kept.rn
  ORDER BY CASE WHEN z.name LIKE 'CITA%' THEN 0 ELSE 1 END, z.char_end - z.char_start, z.k, z.char_start) AS n FROM kept LEFT JOIN z ON kept.doc_id = z.doc_id AND z.char_start <= kept.s AND kept.s < z.char_end)
SELECT doc_id, s AS char_start, e AS char_end, type, name AS zone_hint, default_role AS zone_default_role FROM j WHERE n = 1"""
    return single | more | {k: with_planted((single | more)[k]) for k in ("plate_spans", "cbu_spans", "jurisprudence_zones", "case_names")}


def plain() -> dict[str, str]:
    email = f"WITH {DOCS}, {found(EMAIL)}"
    numbering = """, k AS (SELECT doc_id, i, s, m, min(i) OVER (PARTITION BY doc_id, m) AS f1 FROM f),
nb AS (SELECT *, '[EMAIL_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY f1) || ']' AS ph FROM k)"""
    redacted = f"""{email}{numbering}, pieces AS (SELECT doc_id, i, ps FROM f_i),
red AS (SELECT nb.doc_id, string_agg(ps[nb.i] || ph, '' ORDER BY nb.i) || any_value(ps[len(ps)]) AS redacted FROM nb JOIN pieces p ON nb.doc_id = p.doc_id AND nb.i = p.i GROUP BY nb.doc_id),
er AS (SELECT doc_id, text, coalesce(redacted, text) AS redacted FROM docs LEFT JOIN red USING (doc_id))"""
    return {
        "latest_documents": f"WITH {DOCS} SELECT doc_id, format, path, coalesce(length(text), 0) AS n_chars, CAST(page_count AS BIGINT) AS page_count FROM docs",
        "dni_spans": f"""WITH {DOCS}, {found(DNI, 1)} SELECT doc_id, CAST(s + length(m) - length(g) AS INT) AS char_start, CAST(s + length(m) AS INT) AS char_end, g AS text, replace(g, '.', '') AS normalized
FROM f WHERE regexp_full_match(replace(g, '.', ''), '[0-9]{{7,8}}') AND CAST(replace(g, '.', '') AS BIGINT) BETWEEN 1000000 AND 99999999""",
        "cuit_spans": f"""WITH {DOCS}, {found(rf"\b{D}{{2}}(?:-|{S})?{D}{{8}}(?:-|{S})?{D}\b")}, x AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM f), y AS (SELECT *, 11 - ({CUIT}) % 11 AS c FROM x WHERE length(n) = 11)
SELECT doc_id, s AS char_start, CAST(s + length(m) AS INT) AS char_end, m AS text, n AS normalized FROM y WHERE CASE c WHEN 11 THEN 0 WHEN 10 THEN 9 ELSE c END = CAST(substr(n, 11, 1) AS INT)""",
        "cbu_spans": f"""WITH {DOCS}, {found(r"\b[0-9]{22}\b")}, x AS (SELECT *, m AS n FROM f)
SELECT doc_id, s AS char_start, CAST(s + 22 AS INT) AS char_end, m AS text, n AS normalized FROM x
WHERE (10 - ({BANK}) % 10) % 10 = CAST(substr(n, 8, 1) AS INT) AND (10 - ({ACCOUNT}) % 10) % 10 = CAST(substr(n, 22, 1) AS INT)""",
        "email_spans": f"{email} SELECT doc_id, s AS char_start, CAST(s + length(m) AS INT) AS char_end, m AS text FROM f",
        "phone_spans": f"""WITH {DOCS}, {found(PHONE, 1)}, x AS (SELECT *, regexp_replace(g, '[^0-9]', '', 'g') AS n FROM f)
SELECT doc_id, CAST(s + length(m) - length(g) AS INT) AS char_start, CAST(s + length(m) AS INT) AS char_end, g AS text, n AS normalized FROM x WHERE length(n) BETWEEN 6 AND 14""",
        "plate_spans": f"""WITH {DOCS}, {found(rf"\b[A-Z]{{2}}{S}*{D}{{3}}{S}*[A-Z]{{2}}\b", name="n")}, {found(rf"\b[A-Z]{{3}}{S}*{D}{{3}}\b", name="o")}
SELECT doc_id, s AS char_start, CAST(s + length(m) AS INT) AS char_end, m AS text, 'mercosur' AS formato FROM n
UNION ALL SELECT doc_id, s, CAST(s + length(m) AS INT), m, 'viejo' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.s <= o.s AND o.s < n.s + length(n.m))""",
        "passport_spans": f"""WITH {DOCS}, {found(rf"(?i)pasaporte(?:{S}|[:N°º.])*([A-Z]{{1,3}}{S}?{D}{{6,8}})\b", 1)}
SELECT doc_id, CAST(s + length(m) - length(g) AS INT) AS char_start, CAST(s + length(m) AS INT) AS char_end, g AS text FROM f""",
        "placeholder_numbering": f"{email}{numbering} SELECT doc_id, s AS char_start, ph AS placeholder FROM nb",
        "email_redacted": f"{redacted} SELECT doc_id, redacted FROM er",
        "length_ratio": f"{redacted} SELECT doc_id, 'LENGTH_RATIO' AS code, 'blocker' AS severity FROM er WHERE length(text) > 0 AND (length(redacted) / length(text) < 0.99 OR length(redacted) / length(text) > 1.1)",
        "missing_placeholders": f"""{redacted} SELECT doc_id, 'placeholder missing: ' || p AS message FROM er, (VALUES ('[EMAIL_1]'), ('[EMAIL_2]')) AS v(p) WHERE redacted IS NOT NULL AND NOT contains(redacted, p)""",
        "caption_zone": f"WITH {DOCS}, z AS ({CAPTION_ROWS}) SELECT doc_id, name, s AS char_start, e AS char_end, default_role FROM z WHERE e > 0",
        "signature_zone": f"WITH {DOCS}, {found(SIGNATURE)}, z AS ({SIGNATURE_ROWS}) SELECT doc_id, name, s AS char_start, e AS char_end, default_role FROM z",
        "jurisprudence_zones": windows(COURTS, "CITA_JURISPRUDENCIA", "AUTOR_JURISPRUDENCIA", 250, 30),
        "doctrine_zones": windows(DOCTRINE, "CITA_DOCTRINA", "AUTOR_DOCTRINA", 200, 20),
        "assign_zone": f"""WITH {DOCS}, {found(EMAIL, name="em")}, {found(SIGNATURE)}, z AS ({CAPTION_ROWS} UNION ALL {SIGNATURE_ROWS}),
j AS (SELECT em.doc_id, em.s, z.name, z.default_role, row_number() OVER (PARTITION BY em.doc_id, em.i ORDER BY z.e - z.s, z.s, z.name) AS rn FROM em LEFT JOIN z ON em.doc_id = z.doc_id AND z.s <= em.s AND em.s < z.e)
SELECT doc_id, s AS char_start, name AS zone_hint, default_role AS zone_default_role FROM j WHERE rn = 1""",
        "role_policy": """SELECT * FROM (VALUES ('PARTE_ACTORA', true, 'ACTOR'), ('PARTE_DEMANDADA', true, 'DEMANDADO'), ('TERCERO_CITADO', true, 'TERCERO'), ('TESTIGO', true, 'TESTIGO'), ('VICTIMA', true, 'VICTIMA'),
('MENOR', true, 'MENOR'), ('FAMILIAR_DE_PARTE', true, 'FAMILIAR'), ('LETRADO_PATROCINANTE', true, 'LETRADO'), ('LETRADO_APODERADO', true, 'LETRADO'), ('JUEZ', false, NULL), ('FISCAL', false, NULL),
('DEFENSOR_OFICIAL', false, NULL), ('SECRETARIO', false, NULL), ('PERITO_OFICIAL', false, NULL), ('PERITO_DE_PARTE', true, 'PERITO'), ('AUTOR_DOCTRINA', false, NULL), ('AUTOR_JURISPRUDENCIA', false, NULL),
('FUNCIONARIO_PUBLICO', false, NULL), ('ENTIDAD_PUBLICA', false, NULL), ('ENTIDAD_PRIVADA', true, 'ENTIDAD'), ('DESCONOCIDO', true, 'PERSONA')) AS t(role, anonymize, prefix)""",
        "parse_role": f"WITH {PARTIES} SELECT {ROLE} AS role, count(*) AS n FROM pa GROUP BY 1",
        "policy_of_parties": f"WITH {PARTIES}, r AS (SELECT party_id, {ROLE} AS role FROM pa) SELECT party_id, r.role, true AS anonymize, prefix FROM r LEFT JOIN {PREFIXES} ON r.role = px.role",
        "coref_clusters": f"WITH {MENTIONS} SELECT doc_id, key, role, CAST(round(confidence, 4) AS DOUBLE) AS confidence, first_card, n_mentions, placeholder FROM clusters",
        "coref_replacements": f"WITH {MENTIONS} SELECT doc_id, card_id * 10 AS char_start, placeholder AS replacement FROM keyed JOIN clusters USING (doc_id, key)",
        "company_filter": f"""WITH {PARTIES} SELECT party_id, list_has_any(regexp_extract_all(replace(upper(nombre), '.', ''), '{L}+'), ['SA', 'SRL', 'SAS', 'SACI', 'SACIF', 'SC', 'SH', 'SE'])
OR regexp_matches(upper(nombre), '(^|[^\\p{{L}}\\p{{Nd}}_]){COMPANY}($|[^\\p{{L}}\\p{{Nd}}_])') AS is_company FROM pa WHERE nombre IS NOT NULL""",
        "run_coverage": """WITH r AS (SELECT DISTINCT ON (run_id) * FROM text_runs) SELECT doc_id, count(*) AS num_runs, CAST(max(char_end) AS BIGINT) AS num_chars, string_agg(DISTINCT part, ',' ORDER BY part) AS parts,
bool_or(contains(part, 'header')) AS has_headers, bool_or(contains(part, 'footer')) AS has_footers, bool_or(contains(part, 'footnotes')) AS has_footnotes FROM r WHERE text IS NOT NULL AND text <> '' GROUP BY doc_id""",
        "ocr_pages": """WITH p AS (SELECT DISTINCT doc_id, page_count FROM pdf_documents WHERE page_count > 0), g AS (SELECT doc_id, unnest(range(0, page_count)) AS page FROM p),
n AS (SELECT doc_id, page, sum(length(text)) AS chars FROM (SELECT DISTINCT ON (span_id) * FROM pdf_spans) GROUP BY ALL)
SELECT doc_id, string_agg(CAST(g.page AS VARCHAR), ',' ORDER BY g.page) AS pages FROM g LEFT JOIN n USING (doc_id, page) WHERE coalesce(chars, 0) < 30 GROUP BY doc_id""",
        "rect_groups": """WITH b AS (SELECT DISTINCT ON (span_id) doc_id, page, span_id AS ord, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM pdf_spans),
l AS (SELECT *, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
n AS (SELECT *, CASE WHEN py0 IS NULL OR NOT coalesce((abs(y0 - py0) < (py1 - py0) * 0.5 AND x0 - px1 < (py1 - py0) * 2) OR (y0 >= py0 + (py1 - py0) * 0.5 AND y0 < py1 + (py1 - py0) * 1.5), true) THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY ord) AS group_no FROM n)
SELECT doc_id, page, CAST(group_no AS INT) AS group_no, count(*) AS n, min(ord) AS first_span FROM g GROUP BY ALL""",
        "span_at_point": """WITH b AS (SELECT DISTINCT ON (span_id) doc_id, page, span_id AS ord, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM pdf_spans),
p AS (SELECT doc_id, page, arg_min((x0 + x1) / 2, ord) AS x, arg_min((y0 + y1) / 2, ord) AS y FROM b WHERE y0 IS NOT NULL GROUP BY doc_id, page),
j AS (SELECT p.doc_id, p.page, round(y1 - y0, 3) AS size, row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY abs((y0 + y1) / 2 - y), ord) AS rn FROM p JOIN b USING (doc_id, page)
  WHERE x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2)
SELECT p.doc_id, p.page, coalesce(size, 12.0) AS size, 'Times' AS font FROM p LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (doc_id, page)""",
        "token_counts": "SELECT chunk_id, (coalesce(length(text), 0) + 3) // 4 AS tokens FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)",
        "public_ids": f"""WITH {DOCS}, x AS (SELECT doc_id, path, substr(sha1(coalesce(text, '')), 1, 10) AS public_id FROM docs)
SELECT doc_id, public_id, 'documento_' || public_id || '_anonimizado' || lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS public_name,
{STEM.format('path')} || '_anonimizado' || lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS output_name FROM x""",
        "public_audit": f"""WITH {AUDITS}, {PARTIES} SELECT audit_id, mode, success, count(*) AS n_parties, count(placeholder) AS n_placeholders, CAST(count_if(coalesce(from_caratula, false)) AS BIGINT) AS n_from_caption
FROM au JOIN pa USING (audit_id) GROUP BY ALL""",
        "audit_metrics": f"WITH {AUDITS}, {PARTIES}, {METRICS} SELECT dm.*, coalesce(n, 0) AS n_parties FROM dm LEFT JOIN (SELECT audit_id, count(*) AS n FROM pa GROUP BY audit_id) USING (audit_id)",
        "audit_summary": f"""WITH {AUDITS}, {METRICS} SELECT count(*) AS total, CAST(count_if(has_warnings) AS BIGINT) AS with_warnings, CAST(count_if(n_replacements = 0) AS BIGINT) AS zero_replacements, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
round_even(avg(n_replacements), 1) AS avg_replacements, CAST(median(n_replacements) AS DOUBLE) AS median_replacements, round_even(avg(elapsed_s), 2) AS avg_elapsed_s, round_even(sum(elapsed_s), 1) AS total_elapsed_s,
round_even(coalesce(median(replacements_per_kchar) FILTER (n_pages > 0), 0), 2) AS median_repl_per_kchar, round_even(coalesce(stddev_samp(replacements_per_kchar) FILTER (n_pages > 0), 0), 2) AS stdev_repl_per_kchar FROM dm""",
        "audit_outliers": f"""WITH {AUDITS}, {METRICS}, st AS (SELECT count(*) AS n, avg(replacements_per_kchar) FILTER (n_pages > 0 AND NOT has_warnings) AS mu,
coalesce(stddev_samp(replacements_per_kchar) FILTER (n_pages > 0 AND NOT has_warnings), 0) AS sd FROM dm)
SELECT audit_id, CASE WHEN has_warnings THEN 'warning' ELSE 'low_density' END AS reason, round(CASE WHEN has_warnings THEN NULL WHEN sd = 0 THEN 0 ELSE (replacements_per_kchar - mu) / sd END, 6) AS z
FROM dm, st WHERE n >= 5 AND mu IS NOT NULL AND (has_warnings OR (n_pages > 2 AND replacements_per_kchar < mu - 1.0 * sd))""",
        "audit_csv": f"""WITH {AUDITS}, {PARTIES}, {METRICS} SELECT {STEM.format('input_path')} AS stem, dm.n_pages, dm.text_chars, coalesce(n, 0) AS n_parties, dm.n_replacements, dm.replacements_per_page AS repl_per_page,
dm.replacements_per_kchar AS repl_per_kchar, dm.elapsed_s, dm.model, CAST(has_warnings AS INT) AS has_warnings, CAST(dm.success AS INT) AS success
FROM dm JOIN au USING (audit_id) LEFT JOIN (SELECT audit_id, count(*) AS n FROM pa GROUP BY audit_id) USING (audit_id)""",
        "batch_tally": f"""WITH {AUDITS}, r AS (SELECT CASE WHEN len(warnings) > 0 THEN 2 WHEN success THEN 0 ELSE 1 END AS rc, coalesce(elapsed_s, 0) AS e FROM au)
SELECT CAST(count_if(rc = 0) AS BIGINT) AS ok, CAST(count_if(rc = 2) AS BIGINT) AS review, CAST(count_if(rc = 1) AS BIGINT) AS error, count(*) AS total, CASE WHEN count_if(rc = 1) > 0 THEN 1 WHEN count_if(rc = 2) > 0 THEN 2 ELSE 0 END AS exit_code,
round(sum(e), 4) AS total_s, round(avg(e), 4) AS average_s FROM r""",
        "latest_state": f"WITH {AUDITS} SELECT audit_id, success FROM au",
        "identifier_counts_by_day": f"""WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, full_text AS text, loaded_at FROM docx_documents ORDER BY doc_id), {found(EMAIL, source="d")}
SELECT date_trunc('day', loaded_at) AS window_start, count(*) AS n FROM f JOIN d USING (doc_id) GROUP BY 1""",
    }
