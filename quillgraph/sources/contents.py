"""Books by their tables of contents, and illustrations by the paragraphs around them.

Lines are (book, at, line), in the order of ``at`` within a book. Only headings are folded in order, one short array a book; all else is joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.shaping import clean_heading, titles_match

#: ``3.2 Title`` with marks of a heading before it, and ``Chapter 3 Title``.
SECTION = r"^\s*#*\s*(\d{1,2})\s*[.．]\s*(\d{1,2})\s+(.+)$"
CHAPTER = r"(?i)^\s*#*\s*(?:chapter|第)\s*(\d{1,2})\s*(?:章)?\s*(.*)$"


def numbered(lines: DataFrame, section: str = SECTION, chapter: str = CHAPTER) -> DataFrame:
    """Lines with chapter_no, section_no and title, where they begin with such numbers; null elsewhere."""
    line = F.coalesce("line", F.lit(""))
    of_section, of_chapter = line.rlike(section), line.rlike(chapter)
    number = F.when(of_section, F.regexp_extract(line, section, 1)).when(of_chapter, F.regexp_extract(line, chapter, 1)).cast("int")
    title = F.when(of_section, F.regexp_extract(line, section, 3)).when(of_chapter, F.regexp_extract(line, chapter, 2))
    return lines.withColumns({"chapter_no": number, "section_no": F.when(of_section, F.regexp_extract(line, section, 2).cast("int")), "title": clean_heading(title)})


def contents(pages: DataFrame, front: int = 16, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of lines (book, page, at, line): the table of contents (book, seq, chapter_no, section_no, title, chapter_title), and the body (the lines after it).

    A page of contents is one of a book's first ``front`` pages with ``least`` different sections. The first line with a number counts;
    sections of chapters that the contents don't name are left out.
    """
    place = Window.partitionBy("book").orderBy("page")
    rows = numbered(pages)
    sections = F.size(F.collect_set(F.when(F.col("section_no").isNotNull(), F.struct("chapter_no", "section_no"))))
    counted = rows.groupBy("book", "page").agg(sections.alias("sections")).withColumn("place", F.row_number().over(place))
    listed = counted.where((F.col("place") <= front) & (F.col("sections") >= least)).select("book", "page")
    found = rows.join(listed, ["book", "page"])
    first = F.min(F.struct("page", "at", "title"))["title"]
    chapters = found.where("section_no IS NULL AND chapter_no IS NOT NULL").groupBy("book", "chapter_no").agg(first.alias("chapter_title"))
    named = found.where("section_no IS NOT NULL").groupBy("book", "chapter_no", "section_no").agg(first.alias("title")).join(chapters, ["book", "chapter_no"])
    toc = named.withColumn("seq", F.row_number().over(Window.partitionBy("book").orderBy("chapter_no", "section_no")))
    body = pages.join(listed.groupBy("book").agg(F.max("page").alias("last")), "book", "left").where("last IS NULL OR page > last").drop("last")
    return toc.select("book", "seq", "chapter_no", "section_no", "title", "chapter_title"), body


def aligned(headings: DataFrame, ahead: int = 2, inline: bool = True) -> DataFrame:
    """(book, at, seq) of the headings (book, at, seq) that go on from the one before: later in the contents, by ``ahead`` entries at most.
    Without ``inline`` a row a book: (book, kept), an array of (at, seq).

    So a running head of an earlier section, or a reference to a later one, doesn't open a section, and one missed heading does no harm.
    """
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<at: bigint, seq: int>>").alias("kept"))

    def step(state: Column, h: Column) -> Column:
        fits = (h["seq"] > state["now"]) & (h["seq"] <= state["now"] + ahead)
        return F.struct(F.when(fits, h["seq"]).otherwise(state["now"]).alias("now"), F.when(fits, F.concat(state["kept"], F.array(h))).otherwise(state["kept"]).alias("kept"))

    one = F.struct(F.col("at").cast("long").alias("at"), F.col("seq").cast("int").alias("seq"))
    folded = headings.groupBy("book").agg(F.sort_array(F.collect_list(one)).alias("all")).select("book", F.aggregate("all", start, step)["kept"].alias("kept"))
    return folded.select("book", F.inline("kept")) if inline else folded


def by_sections(body: DataFrame, toc: DataFrame, ahead: int = 2) -> DataFrame:
    """(book, seq, at, line): the body's lines (book, at, line) under the section they belong to; lines before the first section are left out.

    A section's heading has a mark (#), its number and a title that matches. Between the heading of a new chapter and that of its first section, lines
    are the introduction and go to that section. Headings themselves, also repeated ones, are no lines of a section.
    """
    rows = numbered(body.select("book", F.col("at").cast("long").alias("at"), "line").repartition("book"))
    marks = F.col("line").rlike(r"^\s*#")  # a number alone makes no heading in the body
    rows = rows.withColumns({c: F.when(marks, F.col(c)) for c in ("chapter_no", "section_no")})
    chapter = F.col("section_no").isNull() & F.col("chapter_no").isNotNull()
    # a row a book, so lines, contents and headings meet where the lines are, and nothing else of them is shuffled
    listed = toc.select("book", "chapter_no", "section_no", "seq", "title").repartition("book").groupBy("book").agg(F.collect_list(F.struct("chapter_no", "section_no", "seq", "title")).alias("toc"))

    def entry(test: Callable[[Column], Column]) -> Column:
        return F.get(F.filter("toc", test), F.lit(0))

    here = F.when(F.col("section_no").isNotNull(), entry(lambda e: (e["chapter_no"] == F.col("chapter_no")) & (e["section_no"] == F.col("section_no"))))
    known = rows.join(listed.hint("shuffle_hash"), "book", "left").withColumn("here", here)
    named = F.col("here.seq")
    opens = aligned(known.where(named.isNotNull() & titles_match(F.col("here.title"), F.col("title"))).select("book", "at", named.alias("seq")), ahead, inline=False)
    opened = F.when(named.isNotNull(), F.get(F.filter("kept", lambda h: h["at"] == F.col("at")), F.lit(0))["seq"])
    marked = known.join(opens.hint("shuffle_hash"), "book", "left").select("book", "at", "line", "chapter_no", "section_no", named.alias("named"), opened.alias("seq"), F.when(chapter, F.transform("toc", lambda e: F.struct(e["seq"].alias("seq"), e["chapter_no"].alias("chapter_no")))).alias("toc"))
    along = Window.partitionBy("book").orderBy("at")
    rest = along.rowsBetween(0, Window.unboundedFollowing)
    marked = marked.withColumns({"now": F.coalesce(F.last("seq", ignorenulls=True).over(along), F.lit(0)), "next": F.first("seq", ignorenulls=True).over(rest)})
    upcoming, current = entry(lambda e: e["seq"] == F.col("now") + 1)["chapter_no"], entry(lambda e: e["seq"] == F.col("now"))["chapter_no"]
    new = chapter & (F.col("chapter_no") == upcoming) & ~upcoming.eqNullSafe(current)
    within = Window.partitionBy("book", "now").orderBy("at")
    marked = marked.withColumn("intro", F.max(new.cast("int")).over(within))
    seq = F.when(F.coalesce(F.col("intro"), F.lit(0)) == 1, F.col("next")).otherwise(F.col("now"))
    heading = chapter | F.col("seq").isNotNull() | (F.col("named").isNotNull() & (F.col("named") <= F.col("now")))
    return marked.where(~F.coalesce(heading, F.lit(False))).withColumn("seq", seq).where("seq > 0").select("book", "seq", "at", "line")


def anchors(sequence: DataFrame, after: int = 3, before: int = 2) -> DataFrame:
    """(page, at, anchors): for each picture of (page, at, kind, text) the next ``after`` paragraphs of its page, then the ``before`` last ones, nearest first.

    ``kind`` is ``img`` or ``p``. Paragraphs are numbered within their page, so a picture asks for the numbers around its own place: an equal
    join, in both directions.
    """
    along = Window.partitionBy("page").orderBy("at")
    rows = sequence.withColumn("n", F.sum(F.when(F.col("kind") == "p", 1).otherwise(0)).over(along))
    order = [*range(1, after + 1), *range(0, -before, -1)]
    asked = rows.where("kind = 'img'").select("page", "at", "n", F.posexplode(F.array(*map(F.lit, order))).alias("turn", "step")).select("page", "at", "turn", (F.col("n") + F.col("step")).alias("n"))
    there = rows.where("kind = 'p'").select("page", "n", "text")
    found = asked.join(there, ["page", "n"], "left").groupBy("page", "at").agg(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text")))).alias("near"))
    return found.select("page", "at", F.transform("near", lambda x: x["text"]).alias("anchors"))
