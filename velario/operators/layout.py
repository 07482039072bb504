"""Geometry of pages: grouping of rectangles, the span at a point, fonts, and fitting of placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Part of a font's name -> base font; the first that occurs counts (fixed values).
FONTS = (("arial", "helv"), ("helvetica", "helv"), ("calibri", "helv"), ("courier", "cour"), ("consolas", "cour"), ("times", "tiro"), ("georgia", "tiro"), ("garamond", "tiro"), ("cambria", "tiro"))


def base_font(name: Column) -> Column:
    out = F.lit("tiro")
    for k, v in reversed(FONTS):
        out = F.when(F.contains(F.lower(name), F.lit(k)), F.lit(v)).otherwise(out)
    return out


def group_rects(rects: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """``group_no`` of consecutive rectangles of one occurrence: on the line of the one before and near it, or on the next line.

    Gaps and islands: a flag against the previous rectangle, then its running sum.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x0, y0 = F.col("x0"), F.col("y0")
    px1, py0, py1 = F.lag("x1").over(w), F.lag("y0").over(w), F.lag("y1").over(w)
    h = py1 - py0
    same = (F.abs(y0 - py0) < h * 0.5) & (x0 - px1 < h * 2)
    below = (y0 >= py0 + h * 0.5) & (y0 < py1 + h * 1.5)
    new = F.when(py0.isNull() | ~(same | below), 1).otherwise(0)
    return rects.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_new")


def span_at(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """For each point the span whose box (2 wider on each side) holds it and whose middle is nearest in height; else size 12, Times.

    points: keys, point_id, x, y; spans: keys, ord, x0, y0, x1, y1, size, font. The keys (document, page) are the shuffle keys.
    """
    inside = F.col("x").between(F.col("x0") - 2, F.col("x1") + 2) & F.col("y").between(F.col("y0") - 2, F.col("y1") + 2)
    j = points.join(spans, keys).where(inside)
    best = j.groupBy(*keys, "point_id").agg(F.min_by(F.struct("size", "font"), F.struct(F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("y")), F.col("ord"))).alias("s"))
    out = points.join(best, [*keys, "point_id"], "left")
    return out.select(*points.columns, F.coalesce("s.size", F.lit(12.0)).alias("size"), F.coalesce("s.font", F.lit("Times")).alias("font"))


def fit(placeholder: Column, width: Column, size: Column, per_char: Column) -> Column:
    """struct<text, size>: a placeholder too wide is set smaller in steps of a half, down to the larger of 5 and 0.45 of its size;
    one too narrow is centred between dashes. ``per_char`` is the width of a character at size 1."""
    own = F.length(placeholder) * per_char
    least = F.greatest(F.lit(5.0), size * 0.45)
    steps = F.ceil(F.greatest(size - F.try_divide(width, own), F.lit(0.0)) / 0.5)
    bound = F.ceil(F.greatest(size - least, F.lit(0.0)) / 0.5)
    smaller = size - F.least(F.greatest(steps, F.lit(1)), bound) * 0.5
    n = F.floor(F.coalesce(F.try_divide(width - own * size, per_char * size), F.lit(0.0))).cast("int")
    left = F.floor(n / 2).cast("int")
    dashed = F.concat(F.repeat(F.lit("-"), left), placeholder, F.repeat(F.lit("-"), n - left))
    wide = own * size > width
    return F.struct(F.when(wide | (n <= 0), placeholder).otherwise(dashed).alias("text"), F.when(wide, smaller).otherwise(size).alias("size"))


def first_wins(replacements: DataFrame) -> DataFrame:
    """doc_id, original, replacement: one placeholder for each original of a document, that of its first occurrence; longest first."""
    one = replacements.groupBy("doc_id", "original").agg(F.min_by("replacement", "start").alias("replacement"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("original")), "original")))


def uncovered(hits: DataFrame) -> DataFrame:
    """Groups of hits that no longer or earlier group covers: hits: doc_id, page, rank, group_no, x0, y0, x1, y1.

    A group that shares area with a group of a lower rank on its page is left out (an anti join on boxes within the page).
    """
    g = hits.groupBy("doc_id", "page", "rank", "group_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    o = g.select("doc_id", "page", F.col("rank").alias("r"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    same = [g[c] == o[c] for c in ("doc_id", "page")]
    return g.join(o, [*same, o.r < g["rank"], o.o_x0 < g.x1, g.x0 < o.o_x1, o.o_y0 < g.y1, g.y0 < o.o_y1], "left_anti")


def needs_ocr(pages: DataFrame, spans: DataFrame, least: int = 30) -> DataFrame:
    """doc_id, needs_ocr_pages: pages (from a list of all pages, so that empty ones count) with fewer than ``least`` characters."""
    n = spans.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    few = pages.join(n, ["doc_id", "page"], "left").where(F.coalesce("chars", F.lit(0)) < least)
    return few.groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("needs_ocr_pages"))
