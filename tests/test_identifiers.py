import pytest
from pyspark.sql import functions as F

from velario.operators import identifiers as I
from velario.operators.spans import apply_replacements, numbered, resolve_overlaps, span


def spans(spark, text, detector):
    row = spark.createDataFrame([(text,)], "t string").select(detector(F.col("t")).alias("s")).first()
    return row.s


@pytest.mark.parametrize(
    ("text", "found", "digits"),
    [
        ("Juan Pérez, DNI 20.123.456, domicilio", ["20.123.456"], ["20123456"]),
        *[(f"{w} 15.678.901", ["15.678.901"], ["15678901"]) for w in ("DNI", "D.N.I.", "D.N.I", "documento", "L.E.", "LE", "LC")],
        ("Expediente 12.345.678, año 2024", [], []),
        ("DNI 123", [], []),
        ("DNI 1.234.567", ["1.234.567"], ["1234567"]),
        ("DNI 0.234.567", [], []),
        ("😀 DNI: 20123456 y 😀 dni 30.123.456", ["20123456", "30.123.456"], ["20123456", "30123456"]),
    ],
)
def test_dni(spark, text, found, digits):
    got = spans(spark, text, I.dni)
    assert [s.text for s in got] == found and [s.normalized for s in got] == digits
    assert all(text[s.start : s.end] == s.text for s in got)


def test_dni_boundary_is_an_option(spark):
    assert spans(spark, "calle 1234567", I.dni) and not spans(spark, "calle 1234567", lambda t: I.dni(t, strict=True))


def test_cuit_and_cbu_check_digits(spark):
    assert [s.normalized for s in spans(spark, "CUIT 30-50001091-2 o 30500010912", I.cuit)] == ["30500010912"] * 2
    assert not spans(spark, "20123456780 y 20-12345678-0", I.cuit)
    assert len(spans(spark, "CBU 0170035040000002373188.", I.cbu)) == 1
    assert not spans(spark, "0170035040000002373189 1234567890123456789012", I.cbu)


def test_email_phone_plate_passport(spark):
    assert len(spans(spark, "a@b.com, c.d@e.f.ar y x_y@z.org", I.email)) == 3
    assert not spans(spark, "arroba@ sin dominio", I.email)
    for t in ("Tel. 0351-4567890", "teléfono +54 11 4567-8900", "Celular 351 555 1234", "Tel: 43218765", "TELÉFONO 4321-8765"):
        assert len(spans(spark, t, I.phone)) == 1, t
    assert not spans(spark, "expediente 1234567890", I.phone)
    assert [(s.text, s.formato) for s in spans(spark, "AB123CD y ABC 123", I.plate)] == [("AB123CD", "mercosur"), ("ABC 123", "viejo")]
    assert [s.text for s in spans(spark, "Pasaporte AAA123456", I.passport)] == ["AAA123456"]


def test_all_detectors_are_disjoint_and_nulls_empty(spark):
    text = "Sr. X, DNI 20.123.456, CUIT 30-50001091-2, mail a@b.com, tel. 0351-4567890, CBU 0170035040000002373188"
    got = spans(spark, text, I.identifiers)
    assert {s.type for s in got} == {"DNI", "CUIT", "EMAIL", "TELEFONO", "CBU"}
    assert all(a.end <= b.start for a, b in zip(got, got[1:]))
    assert spans(spark, None, I.identifiers) == [] and spans(spark, "", I.identifiers) == []
    assert spans(spark, "Autos N° 1234567 caratulados, Sala II, 12/03/2020", I.identifiers) == []


def brute(spans_):
    rank = {"regex": 100, "text_search": 90, "structure": 80, "ner": 60, "llm": 40}
    kept = []
    for s in sorted(spans_, key=lambda s: (s[0], -rank[s[2]], -(s[1] - s[0]))):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif (rank[s[2]], s[1] - s[0]) > (rank[kept[-1][2]], kept[-1][1] - kept[-1][0]) and rank[s[2]] >= rank[kept[-1][2]]:
            kept[-1] = s
    return kept


def test_resolve_overlaps_against_a_fold(spark):
    import random

    rng = random.Random(4)
    docs = []
    for i in range(150):
        docs.append((i, [(a := rng.randint(0, 60), a + rng.randint(1, 12), rng.choice(["regex", "structure", "ner", "llm", "text_search"])) for _ in range(rng.randint(0, 25))]))
    df = spark.createDataFrame(docs, "i int, x array<struct<a:int,b:int,s:string>>")
    made = F.transform("x", lambda x: span(start=x["a"], end=x["b"], source=x["s"], text=F.lit("")))
    for r in df.select("x", resolve_overlaps(made).alias("r")).collect():
        assert [(s.start, s.end, s.source) for s in r.r] == brute([tuple(x) for x in r.x])


def test_replacement(spark):
    reps = "array<struct<start:int,end:int,replacement:string>>"

    def run(text, r):
        df = spark.createDataFrame([(text, r)], f"t string, r {reps}")
        return df.select(apply_replacements(F.col("t"), F.col("r")).alias("o")).first().o

    assert run("abc 😀 def", [(6, 9, "X"), (0, 3, "")]) == " 😀 X"
    assert run("abc", []) == "abc" and run(None, []) is None
    for bad in ([(0, 2, "X"), (1, 3, "Y")], [(0, 9, "X")]):
        with pytest.raises(Exception, match="replacement"):
            run("abc", bad)


def test_numbering_by_first_appearance(spark):
    text = "DNI 20.123.456 DNI 30.123.456 DNI 20.123.456"
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", I.dni(F.col("t")))
    assert df.select(apply_replacements(F.col("t"), numbered(F.col("s"))).alias("o")).first().o == "DNI [DNI_1] DNI [DNI_2] DNI [DNI_1]"


def test_no_identifier_is_left_after_redaction(spark):
    text = "DNI 20.123.456, mail a@b.com, tel. 0351-4567890"
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", I.identifiers(F.col("t"))).withColumn("o", apply_replacements(F.col("t"), numbered(F.col("s"))))
    assert df.select(F.size(I.identifiers(F.col("o"))).alias("n")).first().n == 0
