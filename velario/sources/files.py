"""Files of a folder: which are input, and their content as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.operators.publish import extension, stem


def folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".pdf", ".docx")) -> DataFrame:
    """path, content, stem, ext of the files to process: known suffixes in any case, outputs left out, subfolders not entered.

    No order: sorting would move every content through a shuffle; callers that list files sort their paths.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")
    named = files.withColumn("stem", stem(F.col("path"))).withColumn("ext", F.lower(extension(F.col("path"))))
    return named.where(F.col("ext").isin(*suffixes) & ~F.endswith("stem", F.lit("_anonimizado")))


AUDIT = """mode string, input string, output string, success boolean, elapsed_s double, parties array<struct<nombre: string, rol: string, placeholder: string, from_caratula: boolean>>,
n_name_spans bigint, n_regex_spans bigint, n_replacements bigint, warnings array<string>, n_pages bigint, text_chars bigint, model string, replacements_per_page double,
replacements_per_kchar double, timings map<string, double>, _corrupt_record string"""


def audits(spark: SparkSession, path: str) -> DataFrame:
    """stem and the fields of every *_audit.json of a folder; files that are no JSON are left out, missing fields are null."""
    raw = spark.read.option("pathGlobFilter", "*_audit.json").text(path, wholetext=True).withColumn("stem", F.regexp_replace(stem(F.input_file_name()), "_audit$", ""))
    rows = raw.select("stem", F.from_json("value", AUDIT, {"mode": "PERMISSIVE"}).alias("a"))
    return rows.where("a is not null and a._corrupt_record is null").select("stem", "a.*").drop("_corrupt_record")


def state(spark: SparkSession, path: str) -> DataFrame:
    """stem, status, note, at of an append-only state log in JSON lines; empty if there is none or it cannot be read."""
    schema = "stem string, status string, note string, at bigint"
    try:
        return spark.read.schema(schema).json(path).where("stem is not null")
    except Exception:  # noqa: BLE001 - an absent log is an empty state
        return spark.createDataFrame([], schema)
