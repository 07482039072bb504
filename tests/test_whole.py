"""Queries over all spans and zones equal brute force on the smallest tables."""

from collections import Counter

from pyspark.sql import functions as F

from velario.operators import zones
from velario.plans import catalog


def test_zones_of_spans(spark, tables):
    got = sorted((r.doc_id, r.char_start, r.char_end, r.type, r.zone_hint or "") for r in catalog.queries()["zones_of_spans"](spark, tables).collect())
    held = {r.doc_id: r.z for r in catalog._docs(spark, tables).select("doc_id", zones.zones(F.col("text")).alias("z")).collect()}
    want = []
    for r in catalog.queries()["resolved_spans"](spark, tables).collect():
        inside = [(-zones.PRIORITY[z.name], z.end - z.start, i, z.name) for i, z in enumerate(held[r.doc_id]) if z.start <= r.char_start < z.end]
        want.append((r.doc_id, r.char_start, r.char_end, r.type, min(inside)[3] if inside else ""))
    assert got == sorted(want)
    assert {"CITA_DOCTRINA", "CARATULA", "FIRMA"} <= {g[4] for g in got}


def test_a_citation_in_a_caption_holds_its_address(spark, tmp_path):
    text = "PAZ, ANA c/ SOL, EVA s/ cobro\nconf. Alterini, escribir a x@y.com hoy.\nY VISTOS: nada"
    rows = [(1, text)]
    spark.createDataFrame(rows, "doc_id bigint, full_text string").selectExpr("doc_id", "'d' docket", "'p.pdf' path", "full_text", "1 page_count", "timestamp'2024-01-01' loaded_at").write.parquet(f"{tmp_path}/pdf_documents.parquet")
    spark.createDataFrame([], "doc_id bigint, docket string, path string, full_text string, loaded_at timestamp").write.parquet(f"{tmp_path}/docx_documents.parquet")
    got = catalog.queries()["zones_of_spans"](spark, str(tmp_path)).where("type = 'EMAIL'").collect()
    assert [(r.char_start, r.zone_hint) for r in got] == [(text.index("x@y"), "CITA_DOCTRINA")]


def test_spans_at_points(spark, tables):
    rows = {}
    for r in spark.read.parquet(f"{tables}/pdf_spans.parquet").select("span_id", "doc_id", "page", "bbox.*").collect():
        rows[r.span_id] = r
    pages: dict = {}
    for r in rows.values():
        pages.setdefault((r.doc_id, r.page), []).append(r)
    want = {}
    for (doc, page), spans in pages.items():
        for p in spans:
            if None in (p.x0, p.y0, p.x1, p.y1):
                continue
            x, y = (p.x0 + p.x1) / 2, (p.y0 + p.y1) / 2
            at = [(abs((b.y0 + b.y1) / 2 - y), b.span_id, b.y1 - b.y0) for b in spans if None not in (b.x0, b.y0, b.x1, b.y1) and b.x0 - 2 <= x <= b.x1 + 2 and b.y0 - 2 <= y <= b.y1 + 2]
            want[p.span_id] = (doc, page, round(min(at)[2], 2))
    found = catalog.queries()["spans_at_points"](spark, tables).collect()
    assert len(found) == len(want) and {r.point_id: (r.doc_id, r.page, round(r["size"], 2)) for r in found} == want
    assert len(want) > len(pages)


def test_identifier_counts_by_type(spark, tables):
    first: dict = {}
    for name in ("pdf_documents", "docx_documents"):
        for r in spark.read.parquet(f"{tables}/{name}.parquet").select("doc_id", "loaded_at").collect():
            first[r.doc_id] = min(first.get(r.doc_id, r.loaded_at), r.loaded_at)
    want = Counter((first[r.doc_id].date(), r.type) for r in catalog.queries()["resolved_identifiers"](spark, tables).collect())
    rows = catalog.queries()["identifier_counts_by_type"](spark, tables).collect()
    assert {(r.window_start.date(), r.type): r.n for r in rows} == want and len(rows) == len(want)
    assert len({t for _, t in want}) > 3
