import pytest
from pyspark.sql import functions as F

from velario.operators import caption, cards, citations, zones
from velario.operators.spans import span


def run(spark, text, of):
    return spark.createDataFrame([(text,)], "t string").select(of(F.col("t")).alias("x")).first().x


def test_caption_zone(spark):
    assert run(spark, "Texto sin marcadores claros." * 50, zones.caption)[0].end == 800
    z = run(spark, "PEREZ c/ GOMEZ\nY VISTOS: algo", zones.caption)[0]
    assert (z.start, z.end) == (0, 14) or z.end == 15
    assert run(spark, None, zones.zones) == [] and run(spark, "", zones.zones) == []


def test_signature_zone(spark):
    assert run(spark, "Firmado: X. " + "a " * 600, zones.signature) == []
    t = "x " * 300 + "PROTOCOLÍCESE. Es copia fiel. Firmado: Juez"
    assert run(spark, t, zones.signature)[0].start == t.rindex("Firmado:")


def test_citation_zones_end_at_a_sentence(spark):
    t = 'CSJN, "Pérez Juan c/ ANSES s/ jubilación". Otra cosa sigue aquí y sigue'
    assert run(spark, t, zones.jurisprudence)[0].end == t.index(". Otra") + 1
    t = "ver doctrina de Alterini, Derecho de las obligaciones. Luego"
    assert run(spark, t, zones.doctrine)[0].end == t.index(". Luego") + 1


def test_most_specific_zone_wins(spark):
    t = "conf. Alterini, obra citada en la carátula\nY VISTOS: x"
    got = run(spark, t, lambda c: zones.zone_at(F.lit(6), zones.zones(c)))
    assert got.name == "CITA_DOCTRINA"
    assert run(spark, t, lambda c: zones.zone_at(F.lit(5000), zones.zones(c))) is None


def test_zone_join_equals_expression(spark):
    docs = spark.createDataFrame([(1, "conf. Alterini, obra\nY VISTOS: x"), (2, "a" * 900)], "doc_id int, t string").withColumn("z", zones.zones(F.col("t")))
    points = spark.createDataFrame([(1, 0), (1, 6), (1, 31), (2, 5), (2, 850)], "doc_id int, start int")
    rows = docs.select("doc_id", F.explode("z").alias("z")).select("doc_id", "z.*")
    joined = {(r.doc_id, r.start): r.zone_hint for r in zones.assign_zones(points, rows).collect()}
    direct = {(r.doc_id, r.start): r.n for r in points.join(docs, "doc_id").select("doc_id", "start", zones.zone_at(F.col("start"), F.col("z"))["name"].alias("n")).collect()}
    assert joined == direct


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("ver doctrina de Alterini, Obra", ["Alterini"]),
        ("(conf. Bidart Campos, Tratado)", ["Bidart Campos"]),
        ("según enseña Lorenzetti", ["Lorenzetti"]),
        ("SEGÚN ENSEÑA Lorenzetti", ["Lorenzetti"]),
        ("ALTERINI, Derecho de las Obligaciones, 2019", ["ALTERINI"]),
        ("nada", []),
    ],
)
def test_doctrine_authors(spark, text, names):
    got = run(spark, text, citations.doctrine_authors)
    assert [s.text for s in got] == names and all(text[s.start : s.end] == s.text and s.preserve for s in got)


def test_case_names(spark):
    t = 'CSJN, "Pérez Juan c/ ANSES s/ jubilación"'
    (s,) = run(spark, t, citations.case_names)
    assert t[s.start : s.end] == s.text == "Pérez Juan c/ ANSES s/ jubilación"


def test_caption_parties_and_all_occurrences(spark):
    t = "DIAZ, GUILLERMO C/ BANCO PATAGONIA S.A. S/ PRO GRATUIDAD\nY VISTOS: DIAZ, GUILLERMO dijo"
    got = run(spark, t, caption.caption_spans)
    assert [s.text for s in got if s.role_hint == "PARTE_ACTORA"] == ["DIAZ, GUILLERMO"] * 2
    assert [s.text.rstrip(".") for s in got if s.role_hint == "PARTE_DEMANDADA"] == ["BANCO PATAGONIA S.A"]
    t = "Miretti, Ana contra Provincia de Córdoba y otros s/ x\nY VISTOS: y"
    assert {s.text for s in run(spark, t, caption.caption_spans)} == {"Miretti, Ana", "Provincia de Córdoba"}


def test_cards(spark):
    text = "Dr. Juan Pérez firma. PROTOCOLÍCESE. Firmado: Ana López"
    made = F.array(
        span(start=F.lit(0), end=F.lit(2), text=F.lit("Dr"), source=F.lit("regex"), type=F.lit("DNI")),
        span(start=F.lit(4), end=F.lit(14), text=F.lit("Juan Pérez"), source=F.lit("ner"), type=F.lit("PER")),
        span(start=F.lit(46), end=F.lit(55), text=F.lit("Ana López"), source=F.lit("structure"), type=F.lit("PER")),
        span(start=F.lit(15), end=F.lit(20), text=F.lit("firma"), source=F.lit("structure"), preserve=F.lit(True)),
    )
    got = run(spark, text, lambda t: cards.cards(t, made, zones.zones(t)))
    assert [(c.card_id, c.text, c.ner_type) for c in got] == [(1, "Juan Pérez", "PER"), (2, "Ana López", None)]
    assert got[0].context_left == "Dr. " and got[1].zone_hint == "FIRMA" and got[1].zone_default_role == "JUEZ"
    assert '"tipo_ner"' not in run(spark, text, lambda t: cards.prompt(F.element_at(cards.cards(t, made, zones.zones(t)), 2)))
