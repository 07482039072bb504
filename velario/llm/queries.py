"""The pN_ queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, encoding, leaks, lookalike, parties, pieces, pii, repeats, scans, sentences
from .common import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _canonical(spark: SparkSession, d: str, changed_only: bool) -> DataFrame:
    spans, runs = _t(spark, d, "pdf_spans"), _t(spark, d, "text_runs")
    words = lookalike.corpus_words(spans.select("text"), runs.select("text"))
    accented = frozenset(w for w in words if not w.isascii())
    return lookalike.normalised(lookalike.units(spans, runs), words, accented, changed_only)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d, True).select("unit_kind", "unit_id").distinct()


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d, False).dropDuplicates(["unit_kind", "unit_id"])


def _finds(spark: SparkSession, d: str) -> DataFrame:
    return pii.finds(pii.documents(_t(spark, d, "pdf_documents"), _t(spark, d, "docx_documents")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _finds(spark, d).select("doc_kind", "doc_id", "pii_type", "char_start").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(pii.documents(_t(spark, d, "pdf_documents"), _t(spark, d, "docx_documents"))).dropDuplicates(["doc_kind", "doc_id"])


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    docs, spans = _t(spark, d, "pdf_documents"), _t(spark, d, "pdf_spans")
    return encoding.damaged(encoding.records(docs, spans), encoding.accented_words([spans.select("text"), docs.select("full_text")]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _damaged(spark, d).select("record_kind", "record_id").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return _damaged(spark, d).dropDuplicates(["record_kind", "record_id"])


def _units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(sentences.inputs(_t(spark, d, "sentences"), _t(spark, d, "chunks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parties.pairs(_t(spark, d, "audit_parties")).distinct()


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return parties.linked(_t(spark, d, "audit_parties"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("unit_kind", "unit_id", "char_start", "char_end").distinct()


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).dropDuplicates(["unit_kind", "unit_id", "sent_no"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(_t(spark, d, "pdf_documents")).select("doc_id", "noise_kind").distinct()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_t(spark, d, "pdf_documents")).dropDuplicates(["doc_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(_t(spark, d, "chunks"), _t(spark, d, "chunk_limits"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_t(spark, d, "chunks"), _t(spark, d, "chunk_limits"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(_t(spark, d, "documents"), directory=spark.conf.get("velario.tokenizers", "/opt/tokenizers"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))
    return found.where(F.col("run_words") >= leaks.RUN).select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repetitive(_t(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repetition(_t(spark, d, "documents"))


def queries() -> dict[str, Query]:
    own = {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

    def ready(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return f(spark, d)

        return run

    return {k: ready(v) for k, v in own.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": "SELECT DISTINCT c.chunk_id FROM chunks c JOIN chunk_limits l ON c.profile = l.profile WHERE (length(c.text) + 3) // 4 > l.max_tokens",
    }
