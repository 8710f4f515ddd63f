"""Boards of clusters: their panels in one table, the report of their drift, what a period holds, names that mark passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the buckets of the board begin: names in a passage, and its characters.
NAME_STARTS, SIZE_STARTS = (0, 2, 4, 7, 11), (0, 400, 550, 700, 900)


def tags(counts: DataFrame, most: int) -> DataFrame:
    """(id, tags, found): the ``most`` most frequent names of each passage, from (id, entity_id, n), and how many there are; ties by entity."""
    # names of a passage are few, so they are one array: counts, which may be costly to make, are read once
    every = counts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "entity_id")))["entity_id"].alias("every"))
    return every.select("id", F.slice("every", 1, most).alias("tags"), F.size("every").cast("long").alias("found"))


def _bucket(value: Column, starts: tuple[int, ...]) -> tuple[Column, list[str]]:
    """The number of the bucket a value falls in (the first one, if it is below all) and the names of all buckets."""
    at = F.lit(0)
    for i, s in enumerate(starts):
        at = F.when(value >= s, F.lit(i)).otherwise(at)
    return at, [f"{a}-{b - 1}" for a, b in zip(starts, starts[1:], strict=False)] + [f"{starts[-1]}+"]


def board(passages: DataFrame, top: int = 10) -> DataFrame:
    """(label, panel, key, n, rank): all panels of all clusters from passages (label, unit, persons, places, found, chars).

    Panels: ``units`` (every unit, in order), ``persons`` (of each passage its first three) and ``places`` (its first two), the
    ``top`` most frequent; ``names`` and ``sizes``: buckets, empty ones with 0. One pass: a passage yields its cells as an
    array, and cells are counted on the map side.
    """
    names_at, names = _bucket(F.coalesce("found", F.lit(0)), NAME_STARTS)
    sizes_at, sizes = _bucket(F.coalesce("chars", F.lit(0)), SIZE_STARTS)

    def cell(panel: str, key: Column) -> Column:
        return F.struct(F.lit(panel).alias("panel"), key.cast("string").alias("key"), F.lit(1).alias("c"))

    def listed(panel: str, column: str, first: int) -> Column:
        return F.transform(F.slice(F.coalesce(F.col(column), F.array().cast("array<string>")), 1, first), lambda k: cell(panel, k))

    zero = F.array(*(F.struct(F.lit(p).alias("panel"), F.lit(str(i)).alias("key"), F.lit(0).alias("c")) for p, ks in (("names", names), ("sizes", sizes)) for i in range(len(ks))))
    one = F.array(cell("units", F.col("unit")), cell("names", names_at), cell("sizes", sizes_at))
    cells = passages.select("label", F.inline(F.concat(one, listed("persons", "persons", 3), listed("places", "places", 2))))
    counted = cells.unionByName(passages.select("label").distinct().select("label", F.inline(zero))).where("key IS NOT NULL").groupBy("label", "panel", "key").agg(F.sum("c").alias("n"))
    number = F.col("key").try_cast("long")
    by = F.when(F.col("panel").isin("persons", "places"), -F.col("n")).otherwise(number)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("label", "panel").orderBy(by, "key")))
    shown = F.when(F.col("panel") == "names", F.get(F.array(*map(F.lit, names)), number.cast("int"))).when(F.col("panel") == "sizes", F.get(F.array(*map(F.lit, sizes)), number.cast("int"))).otherwise(F.col("key"))
    return ranked.where(~F.col("panel").isin("persons", "places") | (F.col("rank") <= top)).select("label", "panel", shown.alias("key"), "n", "rank")


def period_no(period: Column) -> Column:
    """The first whole number in a period's name, 0 if it has none: what periods are sorted by."""
    return F.coalesce(F.regexp_extract(period.cast("string"), r"(\d+)", 1).try_cast("long"), F.lit(0))


def changed_words(words: DataFrame, period: str = "period") -> DataFrame:
    """(label, period, words, fresh, gone, turnover): the keywords (label, period, word, rank) of each period against the cluster's period before.

    The first period of a cluster has nothing fresh or gone. Turnover is one less the Jaccard similarity of the two sets.
    """
    w = Window.partitionBy("label").orderBy("no", "period")
    lists = words.groupBy("label", F.col(period).alias("period")).agg(F.sort_array(F.collect_list(F.struct("rank", "word")))["word"].alias("words")).withColumn("no", period_no(F.col("period")))
    old = lists.withColumn("old", F.lag("words").over(w))
    first = F.col("old").isNull()
    none = F.array().cast("array<string>")
    both = F.size(F.array_union("old", "words"))
    turnover = F.when(first | (both == 0), 0.0).otherwise(F.round(1 - F.size(F.array_intersect("old", "words")) / both, 4))
    return old.select("label", "period", "words", F.when(first, none).otherwise(F.array_except("words", "old")).alias("fresh"), F.when(first, none).otherwise(F.array_except("old", "words")).alias("gone"), turnover.alias("turnover"))


def report(points: DataFrame, names: DataFrame) -> DataFrame:
    """(label, text): a section for each cluster, a line for each of its periods in their order.

    ``points`` is (label, period, count, share, words, fresh, significant), ``names`` (label, name); a cluster without a name is called by its label.
    """
    share = F.format_string("%.1f%%", F.round(F.col("share") * 100, 1))
    fresh = F.when(F.size("fresh") > 0, F.concat(F.lit("; new: "), F.array_join("fresh", ", "))).otherwise("")
    mark = F.when(F.coalesce("significant", F.lit(False)), F.lit(" (marked change)")).otherwise("")
    line = F.concat(F.lit("- **"), F.col("period").cast("string"), F.lit("**: "), F.col("count").cast("string"), F.lit(" ("), share, F.lit("), "), F.array_join("words", ", "), fresh, mark)
    lines = points.select("label", F.struct(period_no(F.col("period")).alias("no"), F.col("period").cast("string").alias("period"), line.alias("line")).alias("l"))
    text = lines.groupBy("label").agg(F.sort_array(F.collect_list("l"))["line"].alias("lines")).join(names.select("label", "name"), "label", "left")
    head = F.concat(F.lit("## "), F.coalesce("name", F.col("label").cast("string")))
    return text.select("label", F.concat(head, F.lit("\n\n"), F.array_join("lines", "\n")).alias("text"))


def snapshot(points: DataFrame, top: int = 6, words: int = 8) -> DataFrame:
    """(period, clusters, fresh, gone): of each period the largest clusters, and the first distinct words that came and went, by label."""
    big = Window.partitionBy("period").orderBy(F.desc("count"), "label")
    largest = points.withColumn("r", F.row_number().over(big)).where(F.col("r") <= top).groupBy("period").agg(F.sort_array(F.collect_list(F.struct("r", "label")))["label"].alias("clusters"))

    def first(column: str) -> DataFrame:
        said = points.select("period", "label", F.posexplode(column).alias("i", "word")).groupBy("period", "word").agg(F.min(F.struct("label", "i")).alias("at"))
        kept = said.withColumn("r", F.row_number().over(Window.partitionBy("period").orderBy("at"))).where(F.col("r") <= words)
        return kept.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("r", "word")))["word"].alias(column))

    none = F.array().cast("array<string>")
    out = largest.join(first("fresh"), "period", "left").join(first("gone"), "period", "left")
    return out.select("period", "clusters", F.coalesce("fresh", none).alias("fresh"), F.coalesce("gone", none).alias("gone"))
