import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from velario.operators import chunking, layout, publish, runs, validate
from velario.sources import docx, files, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        for name, paragraphs in parts.items():
            body = "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs)
            z.writestr(f"word/{name}.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


CONTENT = package(document=[["Juan ", "", "Pé", "rez, DNI ", "20.123.456"], ["Fin."]], header1=[["Cabeza"]])


def frame(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents, 1)], "doc_id bigint, content binary")


def test_docx_text_and_coverage(spark):
    r = docx.runs(frame(spark, CONTENT, b"no zip"))
    text = {x.doc_id: x.text for x in docx.full_text(r).collect()}
    assert text == {1: "Juan Pérez, DNI 20.123.456\nFin.\n\nCabeza"}
    rows = r.where("doc_id = 1").collect()
    assert all(text[1][x.char_start : x.char_end] == x.text for x in rows)
    assert [x.run_index for x in rows][:4] == [0, 2, 3, 4]
    assert r.where("doc_id = 2").first().error
    c = docx.coverage(r).first()
    assert c.has_headers and not c.has_footers and list(c.parts) == ["word/document.xml", "word/header1.xml"]


def test_edits_reach_the_right_runs(spark):
    f = frame(spark, CONTENT)
    r = docx.runs(f)
    reps = spark.createDataFrame([(1, 0, 10, "[P_1]"), (1, 16, 26, "[DNI_1]")], "doc_id bigint, start int, end int, replacement string")
    edits = runs.run_edits(r, reps)
    assert {(e.run_index, e.new_text) for e in edits.collect()} == {(0, "[P_1]"), (2, ""), (3, ", DNI "), (4, "[DNI_1]")}
    made = docx.write(f, edits)
    assert docx.full_text(docx.runs(made)).first().text == "[P_1], DNI [DNI_1]\nFin.\n\nCabeza"
    assert docx.part_names(made.first().content) == docx.part_names(CONTENT)
    assert docx.write(f, edits.limit(0)).first().content == CONTENT


def test_edits_against_replacement_of_the_whole(spark):
    import random

    rng = random.Random(9)
    rows, reps, want = [], [], {}
    for d in range(60):
        parts = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8))]
        text, at = "".join(parts), 0
        for k, p in enumerate(parts):
            rows.append((d, "p", k, p, at, at + len(p)))
            at += len(p)
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 2))))
        pairs = [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if b > a]
        reps += [(d, a, b, "#") for a, b in pairs]
        out, at = "", 0
        for a, b in pairs:
            out, at = out + text[at:a] + "#", b
        want[d] = out + text[at:]
    r = spark.createDataFrame(rows, "doc_id int, part string, run_index int, text string, char_start int, char_end int")
    e = runs.run_edits(r, spark.createDataFrame(reps, "doc_id int, start int, end int, replacement string"))
    new = {(x.doc_id, x.run_index): x.new_text for x in e.collect()}
    got = {d: "".join(new.get((d, k), t) for dd, _, k, t, _, _ in rows if dd == d) for d in want}
    assert got == want


def test_folder_scan_and_audits(spark, tmp_path):
    for n in ("a.docx", "B.DOCX", "a_anonimizado.docx", "x.txt"):
        (tmp_path / n).write_bytes(CONTENT)
    (tmp_path / "a_audit.json").write_text('{"n_replacements": 3, "parties": [{"nombre": "A"}], "warnings": []}')
    (tmp_path / "b_audit.json").write_text("{broken")
    (tmp_path / "c_audit_publico.json").write_text("{}")
    assert sorted(r.stem for r in files.folder(spark, str(tmp_path)).collect()) == ["B", "a"]
    a = files.audits(spark, str(tmp_path)).collect()
    assert [(r.stem, r.n_replacements, r.model) for r in a] == [("a", 3, None)]
    assert files.state(spark, str(tmp_path / "none")).count() == 0


def test_pdf_layout(spark):
    rows = [(1, 0, 0, 0, 0, "ab"), (1, 0, 0, 0, 1, "c"), (1, 0, 0, 1, 0, "d"), (1, 2, 0, 0, 0, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, block_no int, line_no int, span_no int, text string").withColumn("error", F.lit(None).cast("string"))
    assert pdf.full_text(pdf.laid_out(df)).first().text == "abc\nd\n\ne"
    if not pdf.available():
        assert pdf.spans(frame(spark, b"%PDF")).first().error


def test_sentences_and_packing(spark):
    text = "El Dr. Juan Carlos Pérez vino. Dijo que no; que sí; que tal vez. ¡Bien!\n\nFin: 3.5 pesos."
    df = spark.createDataFrame([(text,), ("  \n ",), (None,)], "t string").withColumn("s", chunking.sentences(F.col("t")))
    rows = df.select("s", chunking.pack(F.col("s"), 6, 1).alias("c")).collect()
    s, c = rows[0]
    assert all(text[x.start : x.end] == x.text for x in s) and not any("Dr. " == x.text[-4:] for x in s)
    assert rows[1].s == [] and rows[2].s == [] and rows[1].c == []
    assert [x["index"] for x in c] == list(range(1, len(c) + 1)) and {x.total for x in c} == {len(c)}
    assert c[0].char_start == 0 and c[-1].char_end == len(text)
    plain = df.select(chunking.pack(F.col("s"), 8).alias("c")).first().c
    assert all(x.token_count <= 8 for x in plain)
    assert [(x["index"], x.char_start, x.char_end, x.token_count) for x in plain] == chunking.pack_rows([(x.text, x.start, x.end) for x in s], 8)
    with pytest.raises(ValueError):
        chunking.pack(F.col("s"), 0)


def test_semicolons_are_preferred(spark):
    t = "uno dos tres cuatro; cinco, seis siete ocho"
    df = spark.createDataFrame([(t,)], "t string").select(chunking.pack(F.array(F.struct(F.col("t").alias("text"), F.lit(0).alias("start"), F.length("t").alias("end"))), 6).alias("c"))
    assert [t[x.char_start : x.char_end] for x in df.first().c][0].endswith(";")


def test_validation(spark):
    def issues(a, b, expected=()):
        df = spark.createDataFrame([(a, b, list(expected))], "a string, b string, e array<string>")
        return [(i.code, i.severity) for i in df.select(validate.text_issues(F.col("a"), F.col("b"), F.col("e")).alias("i")).first().i]

    assert issues("x" * 40, "DNI 20.123.456 " + "x" * 20) == [("REGEX_LEAK", "blocker")]
    assert issues("x" * 100, "x" * 10) == issues("x" * 100, "x" * 200) == [("LENGTH_RATIO", "blocker")]
    assert issues("abcdef", "[A_1]f", ["[A_1]", "[B_1]"]) == [("MISSING_PLACEHOLDER", "blocker")]
    assert issues("", "", []) == [] and issues(None, None) == []
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), (["a"], ["a"]), (None, ["a"])], "x array<string>, y array<string>")
    got = [[i.code for i in r.i] for r in df.select(validate.part_changes(F.col("x"), F.col("y")).alias("i")).collect()]
    assert got == [["DOCX_MISSING_PARTS", "DOCX_EXTRA_PARTS"], [], ["DOCX_CORRUPT"]]


def test_publishing(spark):
    r = spark.createDataFrame([("/x/Pérez c. Gil.PDF", "hola")], "p string, t string")
    x = r.select(publish.output_name(F.col("p")).alias("o"), publish.held_name(F.lit("a_anonimizado.pdf")).alias("h"), publish.public_id(F.col("t")).alias("i"), publish.failed_name(F.lit("b.docx")).alias("f")).first()
    import hashlib

    assert x.o == "Pérez c. Gil_anonimizado.pdf" and x.h == "a_anonimizado_REVISAR_NO_PUBLICAR.pdf" and x.i == hashlib.sha1(b"hola").hexdigest()[:10] and x.f == "b_FAILED.docx"
    df = spark.createDataFrame([("PEREZ, JUAN vino", [(0, 11, "[A]")], "Perez,\n juan vino"), ("PEREZ, JUAN vino", [(0, 11, "[A]")], "[A] vino")], "s string, r array<struct<start:int,end:int,replacement:string>>, o string")
    assert [r.l for r in df.select(publish.leaks(F.col("s"), F.col("r"), F.col("o")).alias("l")).collect()] == [["PEREZ, JUAN"], []]


def test_rectangles(spark):
    rects = [(1, 0.0, 0.0, 10.0, 10.0), (2, 11.0, 1.0, 20.0, 11.0), (3, 0.0, 12.0, 9.0, 22.0), (4, 0.0, 80.0, 9.0, 90.0), (5, 90.0, 80.0, 99.0, 90.0)]
    df = spark.createDataFrame([(1, *r) for r in rects], "doc_id int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert [r.group_no for r in layout.group_rects(df, ["doc_id"]).orderBy("ord").collect()] == [1, 1, 1, 2, 3]
    x = spark.createDataFrame([("[A_1]", 100.0, 10.0), ("[DEMANDADO_12]", 20.0, 10.0)], "p string, w double, s double").select(layout.fit(F.col("p"), F.col("w"), F.col("s"), F.lit(0.5)).alias("f")).collect()
    assert (x[0].f.text, x[0].f.size) == ("-------[A_1]--------", 10.0) and (x[1].f.text, x[1].f.size) == ("[DEMANDADO_12]", 5.0)
    assert spark.range(1).select(layout.base_font(F.lit("ABC+Arial-Bold")).alias("f")).first().f == "helv"


def test_ocr_pages_counts_empty_pages(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id int, page int")
    spans = spark.createDataFrame([(1, 0, "x" * 40), (1, 1, "x")], "doc_id int, page int, text string")
    assert layout.needs_ocr(pages, spans).first().needs_ocr_pages == [1, 2]


def test_longest_first_cover(spark):
    reps = spark.createDataFrame([(1, "Juan", "[A]", 9), (1, "Juan Paz", "[B]", 0), (1, "Juan", "[C]", 20)], "doc_id int, original string, replacement string, start int")
    assert [(r.original, r.replacement, r["rank"]) for r in layout.first_wins(reps).orderBy("rank").collect()] == [("Juan Paz", "[B]", 1), ("Juan", "[A]", 2)]
    hits = spark.createDataFrame([(1, 0, 1, 1, 0.0, 0.0, 50.0, 10.0), (1, 0, 2, 1, 0.0, 0.0, 20.0, 10.0), (1, 0, 2, 2, 0.0, 50.0, 20.0, 60.0)], "doc_id int, page int, rank int, group_no int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["rank"], r.group_no) for r in layout.uncovered(hits).collect()} == {(1, 1), (2, 2)}


def test_pandas_is_only_at_the_boundaries():
    assert pd.__version__
