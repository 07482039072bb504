import pytest
from pyspark.sql import functions as F

from velario.operators import coref, entities, names


def val(spark, of, *args):
    row = spark.createDataFrame([args], ", ".join(f"a{i} string" for i in range(len(args))))
    return row.select(of(*[F.col(f"a{i}") for i in range(len(args))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "short"), [("SONZINI, NAHUEL ANTONIO", "S., N. A."), ("ANJOR S.A.", "A. S.A."), ("Juan Pérez", "J. P."), ("Nair Rosa", "N. R."), ("Paraná Seguros SA", "P. S. S.A."), ("DIAZ,", "D."), ("", "")]
)
def test_initials(spark, name, short):
    assert val(spark, names.initials, name) == short


@pytest.mark.parametrize(("name", "yes"), [("PLAN OVALO S.A. DE AHORRO", True), ("Banco Nación", True), ("Rosa Sarmiento", False), ("COOPERATIVA X", True), ("José", False)])
def test_company(spark, name, yes):
    assert val(spark, names.is_company, name) is yes


def test_variants(spark):
    got = val(spark, names.variants, "REYNA, RAQUEL AIDA")
    assert got[0] == "REYNA, RAQUEL AIDA" and {"Reyna, Raquel Aida", "RAQUEL AIDA REYNA", "Raquel Reyna", "REYNA RAQUEL"} <= set(got)
    assert len(got) == len(set(got)) and all(len(v) > 3 for v in got)
    assert not any("," in v for v in val(spark, names.variants, "Juan Carlos Pérez"))
    assert {"ANJOR SA", "ANJOR S.A."} <= set(val(spark, names.variants, "ANJOR S.A."))
    assert val(spark, names.variants, "Juan") == ["Juan"] and val(spark, names.variants, "") == []
    assert "Perez Ana" in val(spark, names.variants, "Pérez, Ana")


def occurrences(spark, text, *forms):
    df = spark.createDataFrame([(text, list(forms))], "t string, f array<string>")
    return df.select(names.name_spans(F.col("t"), F.col("f")).alias("s")).first().s


@pytest.mark.parametrize(
    ("form", "text", "hit"),
    [("Esteban Ruiz", "dijo Estaban Ruiz", True), ("RODINO ANA", "Rodiño\nAna vino", True), ("FARÍAS ANA", "Faría Ana", True), ("Ferrari, Ana", "Ferrari , Ana", True), ("David Ruiz", "Dadid Ruiz", False)],
)
def test_tolerant_search(spark, form, text, hit):
    assert bool(occurrences(spark, text, form)) is hit


def test_longest_occurrence_stays(spark):
    t = "vino Juan Carlos Pérez y JUAN PÉREZ"
    got = occurrences(spark, t, "Juan Carlos Pérez", "Carlos Pérez", "Juan Pérez")
    assert [s.text for s in got] == ["Juan Carlos Pérez", "JUAN PÉREZ"] and all(t[s.start : s.end] == s.text for s in got)


def test_longer_forms(spark):
    assert val(spark, names.longer_forms, "VÁZQUEZ, ELSA A.", "compareció Elsa Alicia Vázquez ayer") == ["Elsa Alicia Vázquez"]
    assert val(spark, names.longer_forms, "Revol, Alfredo", "Alfredo a sus hijos Revol") == []


def test_validation(spark):
    def check(n, t):
        return val(spark, lambda a, b: names.validated(a, names.prepared(b)), n, t)

    assert check("GALLETTINI, EZEQUIEL EMILIANO", "el señor Galletini dijo") == "Galletini, EZEQUIEL EMILIANO"
    assert check("DIAZ, ANA", "vino Ana\nDíaz") == "DIAZ, ANA"
    assert check("ANJOR S.A.", "ANJOR S.A.") is None and check("XX", "XX") is None and check("Nadie, Aquí", "otra cosa") is None


def test_recogniser_cleanup(spark):
    assert val(spark, names.without_junk, "Juan Pérez c/") == "Juan Pérez" and val(spark, names.without_junk, "Ana y otros s. ,") == "Ana"
    assert val(spark, names.is_person, "Señor") is False and val(spark, names.is_person, "Juan") is True


def test_provider_failure_is_a_row(spark):
    class Broken:
        def entities(self, text):
            raise RuntimeError("no model")

    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    r = entities.predict(docs, Broken).first()
    assert r.start is None and "no model" in r.error


@pytest.mark.parametrize(("name", "norm", "key"), [("Dr. Juan Pérez", "juan perez", "perez"), ("Sra. María Ñandú", "maria nandu", "nandu"), ("DON JOSÉ", "jose", "jose"), ("...", "", None)])
def test_normal_names(spark, name, norm, key):
    assert val(spark, coref.normalize_name, name) == norm and val(spark, coref.cluster_key, name) == key
