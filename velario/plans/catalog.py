"""Registered queries of the core: each takes (spark, folder of tables) and reads its whole tables and texts.

Queries that SQL can express have their SQL in ``velario.plans.sql``; the others are tested against brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velario.operators import caption, cards, chunking, citations, coref, entities, identifiers, layout, metrics, names, predict, publish, review, roles, runs, validate, zones
from velario.operators.spans import apply_replacements, explode_spans, numbered, resolve_overlaps
from velario.plans import full, lite, sql
from velario.sources import tables
from velario.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return tables.documents(s, d)


def _planted(s: SparkSession, d: str) -> DataFrame:
    """All rulings and a few that hold what the tables lack (plates, account numbers, cited courts and cases)."""
    return _docs(s, d).select("doc_id", "text").unionByName(s.createDataFrame(sql.PLANTED, "doc_id bigint, text string"))


def _audits(s: SparkSession, d: str) -> DataFrame:
    return tables.once(tables.read(s, d, "audits"), "audit_id", "loaded_at")


def _parties(s: SparkSession, d: str) -> DataFrame:
    return tables.once(tables.read(s, d, "audit_parties"), "party_id")


def _said(s: SparkSession, d: str) -> DataFrame:
    return _parties(s, d).join(_audits(s, d).select("audit_id", "doc_id"), "audit_id").select("doc_id", "seq", "nombre", "rol")


def _spans(s: SparkSession, d: str, of: Callable[[Column], Column], *extra: str, docs: Callable[[SparkSession, str], DataFrame] = _docs) -> DataFrame:
    rows = explode_spans(docs(s, d).select("doc_id", of(F.col("text")).alias("spans")), "doc_id")
    return rows.select("doc_id", F.col("start").alias("char_start"), F.col("end").alias("char_end"), "text", *extra)


# --- identifiers


def latest_documents(s, d):
    return _docs(s, d).select("doc_id", "format", "path", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.col("page_count").cast("bigint").alias("page_count"))


def dni_spans(s, d):
    return _spans(s, d, identifiers.dni, "normalized")


def cuit_spans(s, d):
    return _spans(s, d, identifiers.cuit, "normalized")


def cbu_spans(s, d):
    return _spans(s, d, identifiers.cbu, "normalized", docs=_planted)


def email_spans(s, d):
    return _spans(s, d, identifiers.email)


def phone_spans(s, d):
    return _spans(s, d, identifiers.phone, "normalized")


def plate_spans(s, d):
    return _spans(s, d, identifiers.plate, "formato", docs=_planted)


def passport_spans(s, d):
    return _spans(s, d, identifiers.passport)


def resolved_identifiers(s, d):
    return _spans(s, d, identifiers.identifiers, "type", "source", "confidence", "normalized", "formato")


def identifiers_by_type(s, d):
    rows = explode_spans(_docs(s, d).select("doc_id", identifiers.identifiers(F.col("text")).alias("spans")), "doc_id")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def placeholder_numbering(s, d):
    docs = _docs(s, d).select("doc_id", F.explode_outer(numbered(identifiers.email(F.col("text")))).alias("r")).where("r is not null")
    return docs.select("doc_id", F.col("r.start").alias("char_start"), F.col("r.replacement").alias("placeholder"))


def email_redacted(s, d):
    spans = identifiers.email(F.col("text"))
    return _docs(s, d).withColumn("spans", spans).select("doc_id", apply_replacements(F.col("text"), numbered(F.col("spans"))).alias("redacted"))


def identifiers_redacted(s, d):
    spans = identifiers.identifiers(F.col("text"))
    return _docs(s, d).withColumn("spans", spans).select("doc_id", F.size("spans").alias("n_spans"), apply_replacements(F.col("text"), numbered(F.col("spans"))).alias("redacted"))


# --- structure


def _zones(s, d, of, docs=_docs):
    rows = docs(s, d).select("doc_id", F.explode_outer(of(F.col("text"))).alias("z")).where("z is not null")
    return rows.select("doc_id", "z.name", F.col("z.start").alias("char_start"), F.col("z.end").alias("char_end"), "z.default_role")


def caption_zone(s, d):
    return _zones(s, d, zones.caption)


def signature_zone(s, d):
    return _zones(s, d, zones.signature)


def jurisprudence_zones(s, d):
    return _zones(s, d, zones.jurisprudence, _planted)


def doctrine_zones(s, d):
    return _zones(s, d, zones.doctrine)


def document_zones(s, d):
    return _zones(s, d, zones.zones)


def assign_zone(s, d):
    """The caption or signature zone of every e-mail address (what its SQL states); ``zones_of_spans`` has all spans and zones."""
    docs = _docs(s, d).withColumn("spans", identifiers.email(F.col("text"))).withColumn("zones", F.concat(zones.caption(F.col("text")), zones.signature(F.col("text"))))
    points = explode_spans(docs, "doc_id").select("doc_id", "start")
    rows = docs.select("doc_id", F.explode_outer("zones").alias("z")).where("z is not null").select("doc_id", "z.*")
    return zones.assign_zones(points, rows).select("doc_id", F.col("start").alias("char_start"), "zone_hint", "zone_default_role")


def zones_of_spans(s, d):
    """The zone, citations first, of every resolved span, as an interval join keyed by document."""
    docs = _docs(s, d).withColumn("spans", _resolved(F.col("text"))).withColumn("zones", zones.zones(F.col("text")))
    points = explode_spans(docs, "doc_id").select("doc_id", "start", "end", "type")
    rows = docs.select("doc_id", F.posexplode_outer("zones").alias("ord", "z")).where("z is not null").select("doc_id", "ord", "z.*")
    return zones.assign_zones(points, rows).select("doc_id", F.col("start").alias("char_start"), F.col("end").alias("char_end"), "type", "zone_hint", "zone_default_role")


def doctrine_authors(s, d):
    return _spans(s, d, citations.doctrine_authors, "type")


def case_names(s, d):
    return _spans(s, d, citations.case_names, "type", docs=_planted)


def caption_parties(s, d):
    return _spans(s, d, caption.caption_spans, "role_hint")


def entity_cleanup(s, d):
    """Names of audits as a recogniser might give them: trimmed of junk, stop words marked."""
    p = _parties(s, d).where("nombre is not null")
    return p.select("party_id", names.without_junk(F.col("nombre")).alias("clean"), names.is_person(F.col("nombre")).alias("is_person"))


def _predicted_entities(s, d):
    """Caption parties as the entities a recogniser would give."""
    rows = explode_spans(_docs(s, d).select("doc_id", caption.caption_spans(F.col("text")).alias("spans")), "doc_id")
    return rows.select("doc_id", "start", "end", F.lit("PER").alias("label"))


def entity_spans(s, d):
    e = _predicted_entities(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("e"))
    rows = _docs(s, d).join(e, "doc_id").select("doc_id", entities.entity_spans(F.col("text"), F.col("e")).alias("spans"))
    return explode_spans(rows, "doc_id").select("doc_id", F.col("start").alias("char_start"), F.col("end").alias("char_end"), "text", "type")


def _resolved(t: Column) -> Column:
    return resolve_overlaps(F.concat(identifiers.identifiers(t), citations.citations(t), caption.caption_spans(t)))


def resolved_spans(s, d):
    return _spans(s, d, _resolved, "type", "source")


def entity_cards(s, d):
    rows = cards.explode_cards(full.detected(_docs(s, d)), "doc_id")
    return rows.select("doc_id", "card_id", F.col("start").alias("char_start"), "text", "context_left", "context_right", "zone_hint", "zone_default_role", "ner_type")


# --- roles, predictions, coreference


def role_policy(s, d):
    return roles.policy(s, {"ENTIDAD_PRIVADA": True})


ROLE_OF = {"actor": "PARTE_ACTORA", "actora": "PARTE_ACTORA", "demandado": "PARTE_DEMANDADA", "demandada": "PARTE_DEMANDADA", "tercero": "TERCERO_CITADO", "testigo": "testigo"}


def _role(rol: Column) -> Column:
    out = rol
    for k, v in ROLE_OF.items():
        out = F.when(F.lower(rol) == k, F.lit(v)).otherwise(out)
    return roles.parse_role(out)


def parse_role(s, d):
    return _parties(s, d).groupBy(_role(F.col("rol")).alias("role")).agg(F.count("*").alias("n"))


def policy_of_parties(s, d):
    rows = _parties(s, d).select("party_id", _role(F.col("rol")).alias("role"))
    return roles.with_policy(rows, roles.policy(s)).select("party_id", "role", "anonymize", "prefix")


def _mentions(s, d):
    """Parties of the audits as classified mentions of their document: (card_id, text, role, confidence)."""
    said = _said(s, d).where("nombre is not null and trim(nombre) <> ''")
    return said.select(
        "doc_id", F.col("seq").alias("card_id"), F.col("nombre").alias("text"), (F.col("seq") * 10).alias("start"), (F.col("seq") * 10 + 5).alias("end"), _role(F.col("rol")).alias("role"),
        (F.lit(1.0) - F.pmod(F.col("seq") * 7, F.lit(10)) / 100).alias("confidence"), F.lit(True).alias("anonymize"),
    )


def coref_clusters(s, d):
    c = coref.clusters(_mentions(s, d), roles.policy(s), count_by="role")
    return c.select("doc_id", "key", "role", F.round("confidence", 4).alias("confidence"), "first_card", "n_mentions", "placeholder")


def coref_audit(s, d):
    return coref.audit(coref.clusters(_mentions(s, d), roles.policy(s)))


def coref_replacements(s, d):
    m = _mentions(s, d)
    rows = coref.replacements(m, coref.clusters(m, roles.policy(s), count_by="role"))
    return rows.select("doc_id", F.col("start").alias("char_start"), "replacement")


def _cards(s, d):
    return cards.explode_cards(full.detected(_docs(s, d)), "doc_id")


def _answers(requests: DataFrame) -> DataFrame:
    """Deterministic answers in place of a model: most are valid, some invalid, some leave ids out."""
    ids = F.sequence(F.lit(1), F.lit(10))
    items = F.concat_ws(",", F.transform(ids, lambda i: F.concat(F.lit('{"id":'), (F.col("batch_no") * 10 + i).cast("string"), F.lit(',"rol":"'), F.when(i % 2 == 1, "PARTE_ACTORA").otherwise("testigo"), F.lit('","confianza":0.9}'))))
    kind = F.pmod("doc_id", F.lit(5))
    raw = F.when(kind == 0, F.lit("no JSON")).when(kind == 1, F.lit('{"resultados":[{"id":1,"rol":"JUEZ","confianza":1.5}]}')).otherwise(F.concat(F.lit('{"resultados":['), items, F.lit("]}")))
    return requests.select("doc_id", "batch_no", raw.alias("raw"), F.lit(None).cast("string").alias("error"))


def classify_requests(s, d):
    return predict.requests(_cards(s, d)).select("doc_id", "batch_no", F.length("prompt").alias("prompt_chars"))


def classified_cards(s, d):
    c = _cards(s, d).persist()
    rows = predict.classified(c, _answers(predict.requests(c)), roles.policy(s))
    return rows.select("doc_id", "card_id", "role", "anonymize", "confidence", "source", "raw_role")


def full_pipeline(s, d):
    docs = _docs(s, d)
    asked = predict.requests(cards.explode_cards(full.detected(docs), "doc_id"))
    out = full.full(docs, _answers(asked), roles.policy(s))
    return out.select("doc_id", "n_spans", "n_cards", "n_clusters", F.size("replacements").alias("n_replacements"), "redacted", "success")


# --- names and the light pipeline


def company_filter(s, d):
    return _parties(s, d).where("nombre is not null").select("party_id", names.is_company(F.col("nombre")).alias("is_company"))


def initials(s, d):
    return _parties(s, d).where("nombre is not null").select("party_id", names.initials(F.col("nombre")).alias("initials"))


def name_variants(s, d):
    rows = _parties(s, d).where("nombre is not null").select("party_id", F.posexplode_outer(names.variants(F.col("nombre"))).alias("ord", "variant"))
    return rows.where("variant is not null")


def party_validation(s, d):
    docs = _docs(s, d).select("doc_id", names.prepared(F.col("text")).alias("ready"))
    rows = _said(s, d).where("nombre is not null").join(docs, "doc_id")
    return rows.select("doc_id", "seq", "nombre", names.validated(F.col("nombre"), F.col("ready")).alias("valid"))


def parsed_parties(s, d):
    """Answers with party names, written as a model might write them, parsed back."""
    body = F.to_json(F.struct(F.array(F.struct("nombre", "rol")).alias("partes")))
    fenced = F.when(F.pmod("party_id", F.lit(3)) == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.pmod("party_id", F.lit(3)) == 1, F.concat(F.lit("Parties: "), body)).otherwise(F.concat(body, F.lit(" end")))
    rows = _parties(s, d).where("nombre is not null").select("party_id", F.explode_outer(predict.parties_said(fenced)).alias("p"))
    return rows.where("p is not null").select("party_id", "p.nombre", "p.rol")


def lite_audit(s, d):
    return lite.lite(_docs(s, d), _said(s, d), safe=True).drop("replacements", "redacted")


def lite_redaction(s, d):
    return lite.lite(_docs(s, d), _said(s, d)).select("doc_id", "redacted")


def lite_issues(s, d):
    docs = _docs(s, d)
    return lite.checked(lite.lite(docs, _said(s, d)), docs)


# --- runs, layout, chunks


def run_edits(s, d):
    docs = _docs(s, d).where("format = 'docx'").select("doc_id", F.explode_outer(numbered(identifiers.email(F.col("text")))).alias("r")).where("r is not null").select("doc_id", "r.*")
    return runs.run_edits(tables.once(tables.read(s, d, "text_runs"), "run_id"), docs)


def run_coverage(s, d):
    from velario.sources.docx import coverage

    c = coverage(tables.once(tables.read(s, d, "text_runs"), "run_id"))
    return c.select("doc_id", "num_runs", "num_chars", F.array_join("parts", ",").alias("parts"), "has_headers", "has_footers", "has_footnotes")


def ocr_pages(s, d):
    pages = tables.read(s, d, "pdf_documents").select("doc_id", "page_count").distinct().select("doc_id", F.explode_outer(F.when(F.col("page_count") > 0, F.sequence(F.lit(0), F.col("page_count") - 1))).alias("page"))
    spans = tables.once(tables.read(s, d, "pdf_spans").select("span_id", "doc_id", "page", "text"), "span_id")
    return layout.needs_ocr(pages.where("page is not null"), spans).select("doc_id", F.array_join(F.transform("needs_ocr_pages", lambda p: p.cast("string")), ",").alias("pages"))


def _boxes(s, d):
    p = tables.once(tables.read(s, d, "pdf_spans").select("span_id", "doc_id", "page", "bbox"), "span_id")
    return p.select("doc_id", "page", F.col("span_id").alias("ord"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


def rect_groups(s, d):
    g = layout.group_rects(_boxes(s, d), ["doc_id", "page"])
    return g.groupBy("doc_id", "page", "group_no").agg(F.count("*").alias("n"), F.min("ord").alias("first_span"))


def _sized(s, d):
    return _boxes(s, d).withColumn("size", F.round(F.col("y1") - F.col("y0"), 3)).withColumn("font", F.lit("Times"))


def spans_at_points(s, d):
    """The span found at the middle of every span that has a box; ``point_id`` is its span_id."""
    b = _sized(s, d)
    points = b.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    points = points.select("doc_id", "page", F.col("ord").alias("point_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return layout.span_at(points, b, ["doc_id", "page"]).select("doc_id", "page", "point_id", "size", "font")


def span_at_point(s, d):
    """The span found at the middle of the first span of a page (what its SQL states); ``spans_at_points`` looks up every span."""
    b = _sized(s, d)
    points = b.where("y0 is not null").groupBy("doc_id", "page").agg(F.min_by(F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), "ord").alias("p"))
    points = points.select("doc_id", "page", F.lit(1).alias("point_id"), "p.x", "p.y")
    return layout.span_at(points, b, ["doc_id", "page"]).select("doc_id", "page", "size", "font")


def token_counts(s, d):
    c = tables.once(tables.read(s, d, "chunks").select("chunk_id", "text"), "chunk_id")
    return c.select("chunk_id", chunking.tokens(F.col("text")).cast("bigint").alias("tokens"))


def document_chunks(s, d):
    docs = _docs(s, d).withColumn("sentences", chunking.sentences(F.col("text"))).withColumn("chunks", chunking.pack(F.col("sentences"), 128, 1))
    rows = docs.select("doc_id", F.explode_outer("chunks").alias("c")).where("c is not null")
    return rows.select("doc_id", "c.index", "c.total", "c.char_start", "c.char_end", "c.token_count", F.size("c.sentences").alias("n_sentences"))


# --- validation and publishing


def length_ratio(s, d):
    r = email_redacted(s, d).join(_docs(s, d).select("doc_id", "text"), "doc_id")
    return validate.report(r.withColumn("issues", validate.length_ratio(F.col("text"), F.col("redacted"), 0.99, 1.1))).select("doc_id", "code", "severity")


def regex_leaks(s, d):
    """Identifiers left in texts in which only the e-mail addresses were replaced."""
    return validate.report(email_redacted(s, d).withColumn("issues", validate.identifier_leaks(F.col("redacted")))).select("doc_id", "code", "message")


def missing_placeholders(s, d):
    """Documents whose redacted text lacks the first or second e-mail placeholder."""
    expected = F.array(F.lit("[EMAIL_1]"), F.lit("[EMAIL_2]"))
    return validate.report(email_redacted(s, d).where("redacted is not null").withColumn("issues", validate.missing_placeholders(F.col("redacted"), expected))).select("doc_id", "message")


def obvious_leaks(s, d):
    """Surnames of the parties that a redaction of whole names leaves behind."""
    out = lite.lite(_docs(s, d), _said(s, d)).select("doc_id", "replacements", "redacted")
    j = out.join(_docs(s, d).select("doc_id", "text"), "doc_id")
    return j.select("doc_id", F.explode_outer(publish.leaks(F.col("text"), F.col("replacements"), F.col("redacted"))).alias("leak")).where("leak is not null")


def public_ids(s, d):
    ext = publish.extension(F.col("path"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    return _docs(s, d).select("doc_id", publish.public_id(content).alias("public_id"), publish.public_name(content, ext).alias("public_name"), publish.output_name(F.col("path")).alias("output_name"))


def public_audit(s, d):
    p = _parties(s, d).groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("seq", "party_id", "rol", "placeholder", "from_caratula"))).alias("parties"))
    rows = _audits(s, d).select("audit_id", "mode", "success").join(p, "audit_id")
    rows = rows.select("audit_id", "mode", "success", F.explode_outer(publish.public_parties(F.col("parties"))).alias("p"))
    return rows.groupBy("audit_id", "mode", "success").agg(F.count("*").alias("n_parties"), F.count("p.placeholder").alias("n_placeholders"), F.count_if("p.from_caratula").alias("n_from_caption"))


# --- metrics and review


def audit_metrics(s, d):
    return metrics.doc_metrics(_audits(s, d), _parties(s, d))


def audit_summary(s, d):
    return metrics.summary(metrics.doc_metrics(_audits(s, d)))


def audit_outliers(s, d):
    return metrics.outliers(metrics.doc_metrics(_audits(s, d)), 1.0).select("audit_id", "reason", F.round("z", 6).alias("z"))


def audit_csv(s, d):
    a = _audits(s, d)
    m = metrics.doc_metrics(a, _parties(s, d)).join(a.select("audit_id", publish.stem(F.col("input_path")).alias("_stem")), "audit_id")
    return metrics.for_csv(m, F.col("_stem"))


def batch_tally(s, d):
    a = _audits(s, d)
    rc = F.when(F.size("warnings") > 0, 2).when(F.col("success"), 0).otherwise(1)
    t = metrics.tally(a.select(rc.alias("rc"), F.coalesce("elapsed_s", F.lit(0.0)).alias("elapsed_s")))
    return t.select("ok", "review", "error", "total", "exit_code", F.round("total_s", 4).alias("total_s"), F.round("average_s", 4).alias("average_s"))


def _queue(s, d):
    a = _audits(s, d)
    n = _parties(s, d).groupBy("audit_id").agg(F.countDistinct("party_id").alias("n_parties"))
    rows = a.join(n, "audit_id", "left").select(
        publish.stem(F.col("input_path")).alias("stem"), "n_pages", "n_replacements", "warnings", F.coalesce("n_parties", F.lit(0)).alias("n_parties"), "output_path", "finished_at"
    )
    last = F.ascii(F.right("stem", F.lit(1))) % 4
    state = rows.select("stem", F.when(last == 0, "approved").when(last == 1, "needs_fix").alias("status")).where("status is not null")
    originals = _docs(s, d).select(publish.stem(F.col("path")).alias("stem"))
    return review.queue(originals, rows.drop("output_path", "finished_at"), rows.where("output_path is not null").select("stem"), state)


def review_queue(s, d):
    return review.shown(_queue(s, d))


def review_counts(s, d):
    return review.counts(_queue(s, d))


def latest_state(s, d):
    """The last delivery of every audit, as the latest entry of a log."""
    return review.latest(tables.read(s, d, "audits"), "audit_id", "loaded_at").select("audit_id", "success")


def identifier_counts_by_day(s, d):
    """E-mail addresses of DOCX documents by day (what its SQL states); ``identifier_counts_by_type`` has all types and tables."""
    docs = tables.read(s, d, "docx_documents").select("doc_id", F.col("full_text").alias("text"), "loaded_at").dropDuplicates(["doc_id"])
    rows = docs.select("loaded_at", F.explode_outer(identifiers.email(F.col("text"))).alias("s")).where("s is not null")
    return rows.groupBy(F.window("loaded_at", "1 day").start.alias("window_start")).agg(F.count("*").alias("n"))


def identifier_counts_by_type(s, d):
    """The windowed counts that the stream keeps, over both tables: each document once, at its first delivery."""
    both = None
    for name in ("pdf_documents", "docx_documents"):
        t = tables.read(s, d, name).select("doc_id", F.col("full_text").alias("text"), "loaded_at")
        both = t if both is None else both.unionAll(t)
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("loaded_at")))).where("_n = 1")
    return stream.identifier_counts(first.select("doc_id", "text", "loaded_at"))


def stream_redaction(s, d):
    docs = _docs(s, d).select("doc_id", "text", F.lit(None).cast("timestamp").alias("loaded_at"))
    return stream.redacted(docs).select("doc_id", "n_spans", "redacted")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Identifiers found, resolved, numbered and replaced in every ruling that has one."""
    return identifiers_redacted(s, d).where("n_spans > 0")


NAMES = """latest_documents dni_spans cuit_spans cbu_spans email_spans phone_spans plate_spans passport_spans resolved_identifiers identifiers_by_type placeholder_numbering email_redacted
identifiers_redacted caption_zone signature_zone jurisprudence_zones doctrine_zones document_zones assign_zone zones_of_spans doctrine_authors case_names caption_parties entity_cleanup entity_spans resolved_spans
entity_cards role_policy parse_role policy_of_parties coref_clusters coref_audit coref_replacements classify_requests classified_cards full_pipeline company_filter initials name_variants
party_validation parsed_parties lite_audit lite_redaction lite_issues run_edits run_coverage ocr_pages rect_groups span_at_point spans_at_points token_counts document_chunks length_ratio regex_leaks
missing_placeholders obvious_leaks public_ids public_audit audit_metrics audit_summary audit_outliers audit_csv batch_tally review_queue review_counts latest_state identifier_counts_by_day identifier_counts_by_type
stream_redaction""".split()


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return sql.queries()
