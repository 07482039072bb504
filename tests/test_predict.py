import json

import pytest
from pyspark.sql import functions as F

from velario.operators import coref, predict, roles

CARDS = "doc_id bigint, card_id int, start int, end int, text string, context_left string, context_right string, zone_hint string, zone_default_role string, ner_type string"


def cards(spark, n, doc=1):
    return spark.createDataFrame([(doc, i, i * 10, i * 10 + 4, f"Name{i}", "", "", None, None, "PER") for i in range(1, n + 1)], CARDS)


def answer(spark, raw, batch=0, error=None):
    return spark.createDataFrame([(1, batch, raw, error)], "doc_id bigint, batch_no int, raw string, error string")


def classify(spark, raw, n=2):
    rows = predict.classified(cards(spark, n), answer(spark, raw), roles.policy(spark)).orderBy("card_id").collect()
    return [(r.role, r.confidence, r.source, r.anonymize, r.raw_role) for r in rows]


def test_batches(spark):
    got = predict.requests(cards(spark, 5), 2).orderBy("batch_no").collect()
    assert [r.batch_no for r in got] == [0, 1, 2] and [len(json.loads(r.prompt)["fichas"]) for r in got] == [2, 2, 1]


def test_answers_fail_closed(spark):
    good = '{"resultados":[{"id":1,"rol":" testigo ","confianza":0.9},{"id":99,"rol":"JUEZ"}]}'
    assert classify(spark, good) == [("TESTIGO", 0.9, "llm", True, " testigo "), ("DESCONOCIDO", 0.0, "fallback", True, "FALLBACK:omitted")]
    for bad in ("no json", '{"resultados":[{"id":1,"rol":"JUEZ","confianza":1.5},{"id":2,"rol":"JUEZ"}]}', '{"resultados":[{"rol":"JUEZ"}]}'):
        assert {x[4] for x in classify(spark, bad)} == {"FALLBACK:invalid_json"}
    assert classify(spark, '{"resultados":[{"id":1,"rol":"ROL_X"},{"id":2,"rol":"JUEZ"},{"id":2,"rol":"FISCAL"}]}') == [("DESCONOCIDO", 0.5, "llm", True, "ROL_X"), ("FISCAL", 0.5, "llm", False, "FISCAL")]


def test_client_errors_become_reasons(spark):
    class Down:
        def chat(self, system, user):
            raise RuntimeError("down")

    reqs = predict.requests(cards(spark, 1))
    said = predict.answers(reqs, Down, "system", retries=1, backoff=0)
    assert predict.classified(cards(spark, 1), said, roles.policy(spark)).first().raw_role == "FALLBACK:down"
    calls = []
    assert predict.asked(lambda: calls.append(1) or 1 / 0, retries=2, backoff=0)[0] is None and len(calls) == 3


@pytest.mark.parametrize(
    ("raw", "names"),
    [
        ('```json\n{"partes":[{"nombre":" Ana ","rol":"ACTOR"}]}\n```', [("Ana", "actor")]),
        ('Well: {"partes":[{"nombre":"Ana"},{"rol":"x"}]}', [("Ana", "desconocido")]),
        ('{"partes":[{"nombre":"Ana"}]} and more', []),
        ("nothing", []),
        ('{"otra":1}', []),
    ],
)
def test_parties_said(spark, raw, names):
    got = spark.createDataFrame([(raw,)], "r string").select(predict.parties_said(F.col("r")).alias("p")).first().p
    assert [(p.nombre, p.rol) for p in got] == names


def test_policy(spark):
    t = {r.role: (r.anonymize, r.prefix) for r in roles.policy(spark, {"ENTIDAD_PRIVADA": True, "TESTIGO": False}).collect()}
    assert len(t) == 21 and t["ENTIDAD_PRIVADA"] == (True, "ENTIDAD") and t["TESTIGO"][0] is False and t["JUEZ"] == (False, None)
    with pytest.raises(KeyError):
        roles.policy(spark, {"NADIE": True})


MENTION = "doc_id bigint, card_id int, text string, start int, end int, role string, confidence double, anonymize boolean"


def clusters(spark, rows, **kw):
    df = spark.createDataFrame([(1, i, t, i, i + 1, r, c, True) for i, (t, r, c) in enumerate(rows, 1)], MENTION)
    return df, coref.clusters(df, roles.policy(spark), **kw)


def test_coreference(spark):
    df, c = clusters(spark, [("Juan Pérez", "PARTE_ACTORA", 0.9), ("Sr. Pérez", "PARTE_ACTORA", 0.8), ("PEREZ", "PARTE_ACTORA", 0.7), ("Ana Gil", "TESTIGO", 0.4), ("Gil", "PARTE_ACTORA", 0.95), ("...", "JUEZ", 0.3)])
    got = {r.key: (r.role, r.placeholder, r.n_mentions) for r in c.collect()}
    assert got == {"perez": ("PARTE_ACTORA", "[ACTOR_1]", 3), "gil": ("PARTE_ACTORA", "[ACTOR_2]", 2), "__singleton_6": ("JUEZ", None, 1)}
    assert coref.replacements(df, c).count() == 5


def test_two_kinds_of_counsel_do_not_share_a_placeholder(spark):
    rows = [("Ana Gil", "LETRADO_PATROCINANTE", 0.9), ("Juan Paz", "LETRADO_APODERADO", 0.9)]
    assert {r.placeholder for r in clusters(spark, rows)[1].collect()} == {"[LETRADO_1]", "[LETRADO_2]"}
    assert {r.placeholder for r in clusters(spark, rows, count_by="role")[1].collect()} == {"[LETRADO_1]"}


def test_comma_aware_keys(spark):
    _, c = clusters(spark, [("PÉREZ, JUAN", "TESTIGO", 0.9), ("Juan Pérez", "TESTIGO", 0.9)], comma_aware=True)
    assert c.count() == 1
