import json

import pytest
from pyspark.sql import functions as F

from velario import cli
from velario.operators import metrics, review
from velario.streaming import stream

AUDITS = "audit_id string, n_pages bigint, text_chars bigint, n_replacements bigint, replacements_per_page double, replacements_per_kchar double, elapsed_s double, model string, warnings array<string>, success boolean"


def audits(spark, rows):
    return metrics.doc_metrics(spark.createDataFrame([(n, p, 100, r, None, k, e, m, w, True) for n, p, r, k, e, m, w in rows], AUDITS))


def test_summary_defaults(spark):
    m = audits(spark, [(f"a{i}", None, r, None, e, None, []) for i, (r, e) in enumerate([(6, 4.97), (9, 4.26), (7, 5.0), (15, 3.77), (5, 5.09), (1, 2.48), (9, 4.19)])])
    s = metrics.summary(m).first()
    assert (s.total, s.with_warnings, s.zero_replacements, s.models) == (7, 0, 0, "?")
    assert (s.avg_replacements, s.median_replacements, s.avg_elapsed_s, s.total_elapsed_s, s.median_repl_per_kchar, s.stdev_repl_per_kchar) == (7.4, 7, 4.25, 29.8, 0, 0)
    assert metrics.outliers(m).count() == 0
    assert metrics.summary(m.limit(0)).first().total == 0


def test_outliers(spark):
    rows = [(f"a{i}", 5, 3, 10.0 + i / 10, 1.0, "m", []) for i in range(6)]
    assert metrics.outliers(audits(spark, rows[:4])).count() == 0
    got = metrics.outliers(audits(spark, [*rows, ("low", 5, 1, 0.1, 1.0, "m", []), ("short", 1, 1, 0.1, 1.0, "m", []), ("warned", 1, 1, 9.0, 1.0, "m", ["w"])]), 1.0)
    assert {r.audit_id: r.reason for r in got.collect()} == {"low": "low_density", "warned": "warning"}


def test_tally(spark):
    t = metrics.tally(spark.createDataFrame([(0, 1.0), (2, 3.0), (7, 2.0)], "rc int, elapsed_s double")).first()
    assert (t.ok, t.review, t.error, t.exit_code, t.average_s) == (1, 1, 1, 1, 2.0)


def test_review_queue(spark):
    a = spark.createDataFrame([("a", 1, 3, [], 1), ("b", 1, 0, [], 0), ("c", 1, 2, ["w"], 1), ("d", 1, 2, [], 1)], "stem string, n_pages bigint, n_replacements bigint, warnings array<string>, n_parties bigint")
    originals = spark.createDataFrame([(x,) for x in "abcdz"], "stem string")
    outputs = spark.createDataFrame([(x,) for x in "abc"], "stem string")
    log = spark.createDataFrame([("a", "approved", 1), ("a", "rejected", 2)], "stem string, status string, at int")
    q = review.queue(originals, a, outputs, review.latest(log, "stem", "at"))
    assert {r.stem: (r.status, r.is_problematic) for r in q.collect()} == {"a": ("rejected", False), "b": ("pending", True), "c": ("pending", True), "d": ("pending", True)}
    assert review.shown(q, "rejected").count() == 1 and review.shown(q, "other").count() == 4
    c = review.counts(q).first()
    assert (c["all"], c.problematic, c.pending, c.rejected) == (4, 3, 3, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"mail a{i}@b.com y DNI 20.123.45{i}", f"2024-01-0{1 + i % 3} 10:00:00") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, at string").select("doc_id", "text", F.to_timestamp("at").alias("loaded_at"))
    df.union(df.limit(2)).write.parquet(str(tmp_path / "in"))
    s = stream.deduplicated(stream.documents(spark, str(tmp_path / "in")))
    stream.run(stream.redacted(s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("doc_id", "redacted").collect())) == sorted(map(tuple, stream.redacted(df).select("doc_id", "redacted").collect()))
    n = stream.identifier_counts(stream.documents(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    n.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 16


def test_command_line(spark, tmp_path, capsys):
    from tests.test_documents import package

    body = "comparece y dice que todo es cierto, con DNI 20.123.456. " * 12
    (tmp_path / "caso.docx").write_bytes(package(document=[["DIAZ, ANA c/ PAZ, LUIS s/ cobro"], ["Y VISTOS: DIAZ, ANA ", body]]))
    (tmp_path / "nada.docx").write_bytes(package(document=[["sin partes " * 60]]))
    assert cli.main(["lite", str(tmp_path)]) == 2
    audit = json.loads((tmp_path / "caso_audit.json").read_text())
    assert {p["placeholder"] for p in audit["parties"]} == {"D., A.", "P., L."} and audit["n_replacements"] == 15
    assert json.loads((tmp_path / "nada_audit.json").read_text())["warnings"]
    assert (tmp_path / "caso_anonimizado.docx").exists() and not (tmp_path / "nada_anonimizado.docx").exists()
    assert cli.main(["metrics", str(tmp_path)]) == 0 and cli.main(["metrics", str(tmp_path), "--outliers"]) == 0
    assert cli.main(["review", str(tmp_path), "--set", "caso", "approved"]) == 0
    assert "approved" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["other"])


@pytest.fixture
def model():
    """A chat endpoint that names a party, and gives every mention the role of the plaintiff."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            system, user = (m["content"] for m in asked["messages"])
            if "partes" in system:
                said = {"partes": [{"nombre": "Bruno Sosa", "rol": "Testigo"}]}
            else:
                said = {"resultados": [{"id": x["id"], "rol": "PARTE_ACTORA", "confianza": 0.9} for x in json.loads(user)["fichas"]]}
            body = json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_model_and_full_mode_on_the_command_line(spark, tmp_path, model):
    import zipfile

    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    text = "DIAZ, ANA c/ Bruno Sosa s/ cobro&#10;Y VISTOS: DIAZ, ANA pidió a Bruno Sosa el pago. Correo a@b.com"
    with zipfile.ZipFile(tmp_path / "caso.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    assert cli.main(["lite", str(tmp_path), "--base-url", model]) == 0
    audit = json.loads((tmp_path / "caso_audit.json").read_text())
    assert "Bruno Sosa" in {p["nombre"] for p in audit["parties"]}
    (tmp_path / "caso_anonimizado.docx").unlink()
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"base_url": model, "roles": {"TESTIGO": True}}))
    assert cli.main(["full", str(tmp_path), "--config", str(settings), "--batch-size", "2"]) == 0
    made = zipfile.ZipFile(tmp_path / "caso_anonimizado.docx").read("word/document.xml").decode()
    assert "DIAZ" not in made and "[ACTOR_" in made and "[EMAIL_1]" in made
    assert cli.main(["full", str(tmp_path), "--no-ner", "--dry-run"]) == 0  # nobody answers: every mention is anonymised as unknown
