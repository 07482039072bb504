"""Outputs: audits as JSON, metrics as CSV, the log of a batch, and state as an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audits(df: DataFrame, path: str) -> None:
    """JSON lines, written in parallel; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _store(folder: str):
    """(file system, folder on it): of a URI that names its store (hdfs, s3, gs, file), else of a path all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def binary_files(df: DataFrame, folder: str) -> None:
    """Rows (name, content) as files of a shared folder or object store, written on the executors.

    A file is written whole under its final name; a task that runs again writes the same content again.
    """

    def write(rows) -> None:
        store, root = _store(folder)
        for r in rows:
            with store.open_output_stream(f"{root}/{r['name']}") as out:
                out.write(bytes(r["content"]))

    df.foreachPartition(write)


def audit_files(df: DataFrame, folder: str, name: str = "stem") -> None:
    """One pretty JSON file for each document, written on the executors into a folder or object store that they share."""

    def write(rows) -> None:
        import json

        store, root = _store(folder)
        for r in rows:
            d = r.asDict(recursive=True)
            with store.open_output_stream(f"{root}/{d.pop(name)}_audit.json") as out:
                out.write(json.dumps(d, ensure_ascii=False, indent=2, default=str).encode("utf-8"))

    df.foreachPartition(write)


def metrics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def batch_log(tally: DataFrame, per_file: DataFrame) -> DataFrame:
    """One text column: totals, then a line for each file (name, elapsed_s, rc)."""
    head = tally.select(
        F.explode(
            F.array(
                F.concat(F.lit("files: "), F.col("total").cast("string")),
                F.concat(F.lit("anonymised: "), F.col("ok").cast("string")),
                F.concat(F.lit("manual review: "), F.col("review").cast("string")),
                F.concat(F.lit("errors: "), F.col("error").cast("string")),
                F.format_string("total: %.2f s", F.col("total_s")),
                F.format_string("average: %.2f s", F.col("average_s")),
            )
        ).alias("value")
    )
    status = F.when(F.col("rc") == 0, "ANONIMIZADO_OK").when(F.col("rc") == 2, "REVISION_MANUAL").otherwise("ERROR_TECNICO")
    return head.unionAll(per_file.orderBy("name").select(F.format_string("  %7.2fs  %-20s  %s", F.col("elapsed_s"), status, F.col("name")).alias("value")))


def append_state(df: DataFrame, path: str) -> None:
    """Rows stem, status, note, at are added; readers take the latest of each key."""
    df.write.mode("append").json(path)
