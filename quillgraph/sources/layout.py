"""Boxes of words on pages to lines, and lines to paragraphs.

A page's boxes are one short array that is folded from top to bottom; everything across pages is windows over a book's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.shaping import WIDE

#: A line that begins like this opens a paragraph.
OPENS = r"^(?:\d+(?:\.\d+)+\s|[(（]\d+[)）]|[a-z][)）]|[—–]{2})"
#: What a sentence ends with.
ENDS = r"[.!?。；！？：:;]$"


def lines_of_boxes(boxes: DataFrame, tolerance: float = 0.55, gap: float = 0.3) -> DataFrame:
    """(book, page, line, text, top, size, x0, x1) of boxes (book, page, x, w, top, size, text); lines are numbered from 0, downwards.

    A box joins the line above it if their tops differ by at most ``tolerance`` times the smaller of its size and that of the line's first box; else it opens
    a line. Within a line boxes go from left to right, with a blank where the gap is over ``gap`` times the first box's size. Boxes of blanks alone count nothing.
    """
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in ("top", "x", "w", "size")), F.col("text"))
    pages = boxes.where(F.length(F.trim("text")) > 0).groupBy("book", "page").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("top"), F.lit(0.0).alias("size"), F.array().cast("array<int>").alias("of"))

    def place(s: Column, b: Column) -> Column:
        joins = (s["line"] >= 0) & (F.abs(b["top"] - s["top"]) <= F.least(b["size"], s["size"]) * tolerance)
        line = F.when(joins, s["line"]).otherwise(s["line"] + 1)
        return F.struct(line.alias("line"), F.when(joins, s["top"]).otherwise(b["top"]).alias("top"), F.when(joins, s["size"]).otherwise(b["size"]).alias("size"), F.concat(s["of"], F.array(line)).alias("of"))

    placed = pages.withColumn("of", F.aggregate("boxes", start, place)["of"])
    rows = placed.select("book", "page", F.inline(F.arrays_zip("boxes", "of"))).select("book", "page", F.col("of").alias("line"), "boxes.*")
    item = F.struct("x", "w", "text")
    first = F.min(F.struct("top", "x", "w", "size"))
    made = rows.groupBy("book", "page", "line").agg(F.sort_array(F.collect_list(item)).alias("items"), first.alias("first"), F.max("size").alias("size"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))
    none = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"), F.col("first.size").alias("size"))

    def add(s: Column, i: Column) -> Column:
        apart = F.coalesce((i["x"] - s["end"] > s["size"] * gap) & ~s["text"].endswith(" "), F.lit(False))
        return F.struct(F.concat(s["text"], F.when(apart, " ").otherwise(""), i["text"]).alias("text"), (i["x"] + i["w"]).alias("end"), s["size"].alias("size"))

    return made.select("book", "page", "line", F.aggregate("items", none, add)["text"].alias("text"), F.col("first.top").alias("top"), "size", "x0", "x1")


def paragraphs(lines: DataFrame, opens: str = OPENS, ends: str = ENDS) -> DataFrame:
    """(book, no, page, text) of lines as ``lines_of_boxes`` gives them.

    A line opens a paragraph if it begins like one; if the line before ends two sizes short of the right edge; if it is 2.1 sizes or
    more below that line on its page; or if it is indented by over 1.5 sizes and the line before ends a sentence. The edges are those that a tenth of
    a book's lines are beyond. Lines are joined by a blank, or by nothing between two wide characters.
    """
    def edge(column: str, share: float) -> DataFrame:
        ranked = lines.select("book", column, F.row_number().over(Window.partitionBy("book").orderBy(column)).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("book")).alias("n"))
        return ranked.where(F.col("r") - 1 == F.least(F.col("n") - 1, F.floor(F.col("n") * share))).select("book", F.col(column).alias(f"edge_{column}"))

    rows = lines.join(edge("x0", 0.1), "book").join(edge("x1", 0.9), "book")
    along = Window.partitionBy("book").orderBy("page", "line")
    before = F.lag(F.struct("page", "top", "size", "x1", "text")).over(along)
    rows = rows.withColumn("p", before)
    short = F.col("p.x1") < F.col("edge_x1") - 2 * F.col("p.size")
    below = (F.col("p.page") == F.col("page")) & (F.col("top") - F.col("p.top") > 2.1 * F.greatest("p.size", "size"))
    indented = (F.col("x0") - F.col("edge_x0") > 1.5 * F.col("size")) & F.col("p.text").rlike(ends)
    new = F.col("p").isNull() | F.col("text").rlike(opens) | short | below | indented
    numbered = rows.withColumn("no", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(along))
    parts = numbered.groupBy("book", "no").agg(F.sort_array(F.collect_list(F.struct("page", "line", "text"))).alias("parts"))
    wide_end, wide_start = f"[{WIDE}]$", f"^[{WIDE}]"
    joined = F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0]["text"],
        lambda t, x: F.concat(t, F.when(t.rlike(wide_end) & x["text"].rlike(wide_start), "").otherwise(" "), x["text"]),
    )
    return parts.select("book", "no", F.col("parts")[0]["page"].alias("page"), joined.alias("text"))
