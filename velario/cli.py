"""Command line: python -m velario {lite,full,metrics,review,stream} FOLDER ...

lite      redact the documents of a folder of files (.docx; .pdf if a reader is installed) with parties from a table (--parties), a
          model (--base-url), or the captions alone
full      the same by roles: every mention is classified by answers of a table (--answers) or a model; what nobody answers is anonymised
metrics   figures of the *_audit.json of a folder, outliers, or a CSV
review    the review queue of a folder and its counts; --set STEM STATUS adds to its state
stream    redact parquet files as they arrive in a folder
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.operators import cards, metrics, predict, prompts, review, roles, runs
from velario.operators.publish import output_name
from velario.plans import full, lite
from velario.sources import docx, files, pdf, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="velario", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("lite")
    a.add_argument("folder")
    a.add_argument("--parties", help="table of predictions: stem, nombre, rol")
    a.add_argument("--dry-run", action="store_true", help="audits only, no documents")
    a.add_argument("--safe-publish", action="store_true", help="names of outputs without identities, and a check for leaks")
    a.add_argument("--no-audit", action="store_true")
    a.add_argument("--audit", help="folder of the audits; else the folder of the documents")
    u = sub.add_parser("full")
    u.add_argument("folder")
    u.add_argument("--answers", help="table of answers: stem, batch_no, raw, error")
    u.add_argument("--entities", help="table of a recogniser: stem, start, end, label")
    u.add_argument("--no-ner", action="store_true", help="go on without the table of a recogniser")
    u.add_argument("--dry-run", action="store_true")
    u.add_argument("--batch-size", type=int, default=predict.BATCH, help="mentions of one request")
    for x in (a, u):
        x.add_argument("--base-url", help="chat endpoint of a model; called by the executors")
        x.add_argument("--model", default="local-model")
        x.add_argument("--config", help="JSON file: base_url, model, parties_prompt, roles_prompt, roles (role -> true or false)")
        x.add_argument("--debug", action="store_true", help="show plans and the answers of the model")
    m = sub.add_parser("metrics")
    m.add_argument("folder")
    m.add_argument("--csv")
    m.add_argument("--outliers", action="store_true")
    m.add_argument("--z", type=float, default=2.0)
    r = sub.add_parser("review")
    r.add_argument("folder")
    r.add_argument("--filter", default="problematic")
    r.add_argument("--set", nargs=2, metavar=("STEM", "STATUS"))
    s = sub.add_parser("stream")
    s.add_argument("folder")
    s.add_argument("out")
    s.add_argument("--checkpoint", required=True, help="a folder shared by the executors")
    return p


def _documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, documents, runs) of a folder."""
    f = files.folder(spark, folder).withColumn("doc_id", F.xxhash64("path"))
    run_rows = docx.runs(f.where("ext = '.docx'"))
    texts = docx.full_text(run_rows).withColumn("page_count", F.lit(0))
    if pdf.available():
        laid = pdf.laid_out(pdf.spans(f.where("ext = '.pdf'")))
        pages = laid.groupBy("doc_id").agg(F.max("page_count").alias("page_count"))
        texts = texts.unionByName(pdf.full_text(laid).join(pages, "doc_id"))
    return f, f.select("doc_id", "path", "stem", "ext").join(texts, "doc_id"), run_rows


def _config(a: argparse.Namespace) -> dict:
    """Settings of the configuration file, those of the command line first."""
    c = json.loads(Path(a.config).read_text(encoding="utf-8")) if a.config else {}
    return c | {k: v for k, v in (("base_url", a.base_url), ("model", a.model)) if v and (v != "local-model" or k not in c)}


def _model(c: dict) -> Callable[[], predict.Client]:
    url, model = c["base_url"], c.get("model", "local-model")
    return lambda: predict.HttpClient(url, model)


def _said(spark: SparkSession, a: argparse.Namespace, c: dict, docs: DataFrame) -> DataFrame:
    """doc_id, seq, nombre, rol: the parties of a table in its order, those a model names, or none."""
    if a.parties:
        numbered = spark.read.json(a.parties).withColumn("seq", F.monotonically_increasing_id())  # before the join: the order of the table
        return numbered.join(docs.select("doc_id", "stem"), "stem").select("doc_id", "seq", "nombre", "rol")
    if not c.get("base_url"):
        return spark.createDataFrame([], "doc_id bigint, seq bigint, nombre string, rol string")
    answers = predict.answers(predict.party_prompts(docs.where("text is not null")), _model(c), c.get("parties_prompt", prompts.PARTIES)).persist()  # a model is asked once
    if a.debug:
        answers.show(20, 400)
    named = answers.select("doc_id", F.posexplode_outer(predict.parties_said(F.col("raw"))).alias("seq", "p")).where("p is not null")
    return named.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "p.nombre", "p.rol")


def run_full(spark: SparkSession, a: argparse.Namespace) -> int:
    c = _config(a)
    f, docs, run_rows = _documents(spark, a.folder)
    policy = roles.policy(spark, c.get("roles"))
    found = None
    if a.entities and not a.no_ner:
        found = spark.read.json(a.entities).join(docs.select("doc_id", "stem"), "stem").select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label")
    if a.answers:
        table = spark.read.schema("stem string, batch_no int, raw string, error string").json(a.answers)
        said = table.join(docs.select("doc_id", "stem"), "stem").select("doc_id", "batch_no", "raw", "error")
    elif c.get("base_url"):
        asked = predict.requests(cards.explode_cards(full.detected(docs, found), "doc_id"), a.batch_size)
        known = ", ".join(r.role for r in policy.select("role").orderBy("role").collect())  # the fixed table of roles
        system = c.get("roles_prompt", prompts.ROLES)
        said = predict.answers(asked, _model(c), system % known if "%s" in system else system).persist()
    else:
        said = spark.createDataFrame([], "doc_id bigint, batch_no int, raw string, error string")
    out = full.full(docs, said, policy, found, a.batch_size).persist()
    if a.debug:
        out.explain("formatted")
        full.stages(out).show()
    t = out.agg(F.count("*").alias("n"), F.count_if("success").alias("ok")).first()
    if not t.n:
        print("no documents", file=sys.stderr)
        return 2
    if not a.dry_run:
        good = out.where("success").join(f.select("doc_id", "path"), "doc_id")
        reps = good.select("doc_id", F.explode_outer("replacements").alias("r")).where("r is not null").select("doc_id", "r.*")
        made = docx.write(f.where("ext = '.docx'"), runs.run_edits(run_rows, reps)).join(good.where(F.size("replacements") > 0).select("doc_id", output_name(F.col("path")).alias("output")), "doc_id")
        sinks.binary_files(made.select(F.col("output").alias("name"), "content"), a.folder)
    out.unpersist()
    said.unpersist()
    print(f"{t.ok} anonymised, {t.n - t.ok} for review")
    return 0 if t.ok == t.n else 2


def run_lite(spark: SparkSession, a: argparse.Namespace) -> int:
    f, docs, run_rows = _documents(spark, a.folder)
    said = _said(spark, a, _config(a), docs)
    began = time.time()
    out = lite.lite(docs, said, safe=a.safe_publish).persist()
    if a.debug:
        out.explain("formatted")
    rc = F.when(F.col("success"), 0).otherwise(2)
    per_file = out.select(F.col("path").alias("name"), rc.alias("rc"), F.lit(None).cast("double").alias("elapsed_s"))
    tally = metrics.tally(per_file.withColumn("elapsed_s", F.lit(0.0))).first()
    if not tally.total:
        print("no documents", file=sys.stderr)
        return 2
    if not a.no_audit:
        sinks.audit_files(out.join(docs.select("doc_id", "stem"), "doc_id").drop("doc_id", "replacements", "redacted"), a.audit or a.folder)
    if not a.dry_run:
        reps = out.where("success").select("doc_id", F.explode_outer("replacements").alias("r")).where("r is not null").select("doc_id", "r.*")
        made = docx.write(f.where("ext = '.docx'"), runs.run_edits(run_rows, reps)).join(out.where("success and n_replacements > 0").select("doc_id", "output"), "doc_id")
        sinks.binary_files(made.select(F.col("output").alias("name"), "content"), a.folder)
    out.unpersist()
    said.unpersist()
    print(f"{tally.ok} anonymised, {tally.review} for review, {tally.error} errors, {time.time() - began:.1f} s")
    return tally.exit_code


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    a = files.audits(spark, folder).withColumnRenamed("stem", "audit_id")
    return metrics.doc_metrics(a).drop("n_parties").join(a.select("audit_id", F.coalesce(F.size("parties"), F.lit(0)).cast("bigint").alias("n_parties")), "audit_id")


def _print(rows: DataFrame) -> None:
    """Every row, as tab-separated lines; rows come to the driver one partition at a time."""
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def run_metrics(spark: SparkSession, a: argparse.Namespace) -> int:
    m = _metrics(spark, a.folder)
    if a.csv:
        sinks.metrics_csv(metrics.for_csv(m, F.col("audit_id")), a.csv)
    _print(metrics.outliers(m, a.z).select("audit_id", "reason", "z").orderBy("audit_id") if a.outliers else metrics.summary(m))
    return 0


def run_review(spark: SparkSession, a: argparse.Namespace) -> int:
    log = f"{a.folder}/_review_state"
    if a.set:
        if a.set[1] not in review.STATUSES:
            print("unknown status", file=sys.stderr)
            return 1
        sinks.append_state(spark.createDataFrame([(*a.set, "", time.time_ns())], "stem string, status string, note string, at bigint"), log)
    audits = files.audits(spark, a.folder)
    names = spark.read.format("binaryFile").load(a.folder).select("path")
    from velario.operators.publish import stem

    all_ = names.select(stem(F.col("path")).alias("stem"), F.lower(F.col("path")).alias("p")).where(F.col("p").rlike(r"\.(pdf|docx)$"))
    originals = all_.where(~F.endswith("stem", F.lit("_anonimizado"))).select("stem")
    outputs = all_.where(F.endswith("stem", F.lit("_anonimizado"))).select(F.regexp_replace("stem", "_anonimizado$", "").alias("stem"))
    entries = review.queue(
        originals, audits.select("stem", "n_pages", "n_replacements", "warnings", F.coalesce(F.size("parties"), F.lit(0)).alias("n_parties")), outputs, review.latest(files.state(spark, log), "stem", "at")
    )
    _print(review.shown(entries, a.filter).orderBy("stem"))
    review.counts(entries).show()
    return 0


def run_stream(spark: SparkSession, a: argparse.Namespace) -> int:
    from velario.streaming import stream

    stream.run(stream.redacted(stream.deduplicated(stream.documents(spark, a.folder))), a.out, a.checkpoint).awaitTermination()
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("velario").getOrCreate()
    return {"lite": run_lite, "full": run_full, "metrics": run_metrics, "review": run_review, "stream": run_stream}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
