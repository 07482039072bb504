"""Tables of rulings: one row for each document, whatever its format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a partition that is worth a task of its own.
TASK_BYTES = 64 << 20


def once(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the latest delivery by ``order``, any of equal rows without it.

    Without an order this is an aggregation that combines before its shuffle; with one, a window on the key. The engine decides the number
    of partitions and splits them at run time; only a small table, which it would put into one task, is spread over the cores, since
    what follows is work on the texts.
    """
    if not order:
        return df.dropDuplicates([key])
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * TASK_BYTES:
        df = df.repartition(cores, key)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, format, docket, path, text, page_count of all PDF and DOCX documents."""
    pdf = read(spark, folder, "pdf_documents").select("doc_id", F.lit("pdf").alias("format"), "docket", "path", F.col("full_text").alias("text"), "page_count", "loaded_at")
    docx = read(spark, folder, "docx_documents").select("doc_id", F.lit("docx").alias("format"), "docket", "path", F.col("full_text").alias("text"), F.lit(0).alias("page_count"), "loaded_at")
    return once(pdf.unionAll(docx), "doc_id", "loaded_at").drop("loaded_at")
