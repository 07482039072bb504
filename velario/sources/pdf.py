"""PDF files, if a library that reads them is installed; else tables of spans take their place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN_SCHEMA = "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_no int, span_no int, page_count int, error string"


def available() -> bool:
    try:
        import fitz  # noqa: F401
    except ImportError:
        return False
    return True


def spans(files: DataFrame) -> DataFrame:
    """Text spans of every file (doc_id, content), numbered within their block and line; a file that cannot be read gives its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    import fitz

                    with fitz.open(stream=bytes(content), filetype="pdf") as d:
                        for p, page in enumerate(d):
                            for bn, block in enumerate(x for x in page.get_text("dict")["blocks"] if x.get("type", 0) == 0):
                                for ln, line in enumerate(block["lines"]):
                                    for sn, s in enumerate(x for x in line["spans"] if x["text"]):
                                        rows.append((i, p, *s["bbox"], s["text"], bn, ln, sn, d.page_count, None))
                except Exception as e:  # noqa: BLE001 - a broken or unreadable file is a row, not a failed job
                    rows.append((i, *[None] * 10, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPAN_SCHEMA.split(", ")])

    return files.select("doc_id", "content").mapInPandas(run, SPAN_SCHEMA)


def laid_out(span_rows: DataFrame) -> DataFrame:
    """The spans with char_start and char_end: a line feed after each line, one more between pages. Prefix sums within a document."""
    order = ["page", "block_no", "line_no", "span_no"]
    w = Window.partitionBy("doc_id").orderBy(*order)
    same_page = F.lag("page").over(w) == F.col("page")
    same_line = same_page & (F.lag("block_no").over(w) == F.col("block_no")) & (F.lag("line_no").over(w) == F.col("line_no"))
    gap = F.when(F.lag("page").over(w).isNull() | F.coalesce(same_line, F.lit(False)), 0).when(same_page, 1).otherwise(2)
    end = F.sum(F.length("text") + F.col("_gap")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return span_rows.where("error is null").withColumn("_gap", gap).withColumn("char_end", end.cast("int")).withColumn("char_start", (F.col("char_end") - F.length("text")).cast("int")).drop("_gap")


def full_text(laid: DataFrame) -> DataFrame:
    """doc_id, text of laid-out spans."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, r: F.struct(F.concat(acc["out"], F.repeat(F.lit("\n"), r["char_start"] - acc["at"]), r["text"]).alias("out"), r["char_end"].alias("at"))
    grouped = laid.where("text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "text"))).alias("rs"))
    return grouped.select("doc_id", F.aggregate("rs", zero, step, lambda a: a["out"]).alias("text"))
