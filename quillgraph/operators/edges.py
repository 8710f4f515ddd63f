"""Claims to relations: deduplication, aggregated edges, strength, degrees, entity statistics, counts.

All functions take and return DataFrames with the columns of the graph model (src, dst, predicate, ch, confidence, status,
claim_id, evidence). Ties are broken by (ch, claim_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.storage import stored

EDGE = ["src", "predicate", "dst"]
#: Distinct values that are sent to all tasks to be looked up; more are joined.
BROADCAST_VALUES = 500_000


def deduplicated(claims: DataFrame) -> DataFrame:
    """One row for each (src, predicate, dst, ch): mentions, the largest confidence, evidence of the first claim that has it.

    Empty evidence doesn't replace evidence, so the best claim with evidence wins, if any has some.
    """
    none = F.when(F.coalesce("evidence", F.lit("")) != "", 0).otherwise(1)
    first = F.struct(none.alias("none"), (-F.col("confidence")).alias("less"), "claim_id")
    return claims.groupBy(*EDGE, "ch").agg(F.count("*").alias("mentions"), F.max("confidence").alias("confidence"), F.min_by("evidence", first).alias("evidence"))


def symmetric(claims: DataFrame, predicates: list[str]) -> DataFrame:
    """Claims whose symmetric predicates have the smaller id as subject."""
    turn = F.col("predicate").isin(predicates)
    return claims.withColumns({"src": F.when(turn, F.least("src", "dst")).otherwise(F.col("src")), "dst": F.when(turn, F.greatest("src", "dst")).otherwise(F.col("dst"))})


def edges(claims: DataFrame) -> DataFrame:
    """Relations: support (claims), the distinct units in order, the largest and the mean confidence, first and last unit."""
    units = F.sort_array(F.collect_set("ch"))
    return claims.groupBy(*EDGE).agg(
        F.count("*").alias("support_count"), units.alias("chapters"), F.max("confidence").alias("confidence"), F.avg("confidence").alias("confidence_avg"), F.min("ch").alias("first_chapter"), F.max("ch").alias("last_chapter")
    )


def entity_units(places: DataFrame) -> DataFrame:
    """(entity_id, first, units) from places (entity_id, ch) in any number: the first unit, and all as an array of bit sets.

    A bit set holds 32 units in its low half and which 32 in its high half, so a row has a few numbers however often an entity stands.
    """
    block = F.floor(F.col("ch") / 32).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("ch", F.lit(32)).cast("int"))
    # claims of one text stand together, so the map side combines some
    sets = places.groupBy("entity_id", block.alias("block")).agg(F.bit_or(bit).alias("bits"), F.min("ch").alias("first"))
    packed = F.shiftleft("block", 32).bitwiseOR(F.col("bits"))
    return sets.groupBy("entity_id").agg(F.min("first").alias("first"), F.collect_list(packed).alias("units"))


def shared_units(a: str, b: str) -> Column:
    """In how many units two entities both stand, from their ``units``; 0 where one has none."""
    low = (1 << 32) - 1

    def with_one(s: Column, x: Column) -> Column:
        return s + F.aggregate(b, F.lit(0), lambda n, y: n + F.when(F.shiftright(x, 32) == F.shiftright(y, 32), F.bit_count(x.bitwiseAND(y).bitwiseAND(F.lit(low)))).otherwise(0))

    return F.coalesce(F.aggregate(a, F.lit(0), with_one), F.lit(0)).cast("long")


def _measured(claims: DataFrame, cite: list[str], order: list, per_edge: int) -> DataFrame:
    """Relations with the measures that their strength takes. Claims are dealt by subject, so nothing else is shuffled: first a row a unit, then a row a relation.

    With ``cite``, these columns of a relation's first ``per_edge`` claims by ``order`` go along, numbered from 1 (``key_1``, ``key_2``).
    """
    dealt = claims.select(*EDGE, "ch", "confidence", *cite).repartition("src")
    if cite:
        dealt = dealt.withColumn("_turn", F.row_number().over(Window.partitionBy(*EDGE).orderBy(*order)))
    cited = {f"{c}_{i}": F.when(F.col("_turn") == i, F.col(c)) for i in range(1, per_edge + 1) for c in cite}
    by_unit = dealt.groupBy(*EDGE, "ch").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("sum"), F.count("confidence").alias("of"), F.max("confidence").alias("most"), *(F.max(v).alias(c) for c, v in cited.items()))
    return by_unit.groupBy(*EDGE).agg(
        F.sum("n").alias("support_count"), F.count("ch").cast("int").alias("archive_count"), F.max("most").alias("confidence"), (F.sum("sum") / F.sum("of")).alias("confidence_avg"), F.min("ch").alias("first_chapter"), F.max("ch").alias("last_chapter"),
        *(F.max(c).alias(c) for c in cited),
    )


def cumulative_share(df: DataFrame, value: str, out: str, scale: int = 1000) -> DataFrame:
    """Append the share of rows whose ``value`` is at most the row's own (the percentile rank).

    Rows are counted by value first (combined on the map side); only distinct values are ranked, in buckets of width
    1 / ``scale``, so a value that many rows share is one row of a window.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_bucket", F.floor(F.col("_v") * scale))
    sizes = counts.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    below = sizes.select("_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_below"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_v"))
    ranked = stored(counts.withColumn("_upto", upto).join(below, "_bucket").select("_v", ((F.col("_below") + F.col("_upto")) / F.col("_all")).alias(out)), "ranks")
    if ranked.count() <= BROADCAST_VALUES:  # rows then stay where they are
        ranked = F.broadcast(ranked)
    return df.join(ranked, F.col(value) == F.col("_v")).drop("_v")


def _scored(claims: DataFrame, units: DataFrame, cite: list[str], order: list, per_edge: int) -> DataFrame:
    """``_measured`` with co-mentions and the combination that is ranked (``raw``)."""
    ends = [units.select(F.col("entity_id").alias(end), F.col("units").alias(f"_{end}")) for end in ("src", "dst")]
    e = _measured(claims, cite, order, per_edge).join(ends[0], "src", "left").join(ends[1], "dst", "left").withColumn("co_mention", shared_units("_src", "_dst")).drop("_src", "_dst")
    raw = F.log1p("support_count") + 1.2 * F.log1p("archive_count") + 0.5 * F.log1p("co_mention") + F.col("confidence_avg")
    return e.withColumn("raw", F.round(raw, 9))


def edge_metrics(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Edges with their strength: claim, unit and co-mention counts, mean confidence, and the percentile of their combination as weight.

    ``units`` is what ``entity_units`` gives, stored: it is read for both ends. Ids can be of any type; numbers make narrow rows.
    Claims are shuffled by subject and relations by object; the scores are written once, and ranked by their distinct values.
    """
    e = cumulative_share(stored(_scored(claims, units, [], [], 0), "edges-scored"), "raw", "share")
    return e.select(*EDGE, F.col("support_count").alias("claim_count"), "archive_count", "co_mention", F.round("confidence_avg", 4).alias("confidence_avg"), "confidence", "first_chapter", "last_chapter", F.round("share", 4).alias("weight"))


def cited_edges(claims: DataFrame, units: DataFrame, cite: list[str], order: list, per_edge: int = 2) -> DataFrame:
    """(src, predicate, dst, weight, firsts): edges with the weight of ``edge_metrics`` and their first ``per_edge`` claims by ``order``, as structs of the columns ``cite``.

    Both come from one pass over the claims, so claims and metrics needn't be joined by edge.
    """
    e = _scored(claims, units, cite, order, per_edge).select(*EDGE, "raw", F.least("support_count", F.lit(per_edge)).cast("byte").alias("of"), *(f"{c}_{i}" for i in range(1, per_edge + 1) for c in cite))
    e = cumulative_share(stored(e, "edges-cited"), "raw", "share")
    firsts = F.array(*(F.struct(*(F.col(f"{c}_{i}").alias(c) for c in cite)) for i in range(1, per_edge + 1)))
    return e.select(*EDGE, F.round("share", 4).alias("weight"), F.slice(firsts, F.lit(1), F.col("of").cast("int")).alias("firsts"))


def undirected(metrics: DataFrame) -> DataFrame:
    """(a, b, weight): parallel edges summed, loops left out, a < b. Dealt by ``a``, which joins and sums by it make use of."""
    pairs = metrics.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").repartition("a")
    return pairs.groupBy("a", "b").agg(F.round(F.sum("weight"), 6).alias("weight"))


def weighted_degree(graph: DataFrame) -> DataFrame:
    """(entity_id, weighted_degree, degree) over an undirected graph."""
    ends = graph.select(F.explode(F.array("a", "b")).alias("entity_id"), "weight")
    return ends.groupBy("entity_id").agg(F.round(F.sum("weight"), 4).alias("weighted_degree"), F.count("*").alias("degree"))


def claim_counts(claims: DataFrame) -> DataFrame:
    """(entity_id, claim_count): claims in which an entity is subject or object."""
    return claims.select(F.explode(F.array("src", "dst")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("claim_count"))


def entity_statistics(entities: DataFrame, claims: DataFrame, appearances: DataFrame) -> DataFrame:
    """Entities that have claims or are heroes, with first and last unit, number of units, mentions and claims."""
    seen = appearances.groupBy("entity_id").agg(F.min("ch").alias("first_chapter"), F.max("ch").alias("last_chapter"), F.count("*").alias("chapter_count"), F.sum("n").alias("mention_count"))
    out = entities.join(seen, "entity_id", "left").join(claim_counts(claims), "entity_id", "left")
    return out.withColumn("claim_count", F.coalesce("claim_count", F.lit(0))).where((F.col("claim_count") > 0) | F.col("is_hero"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def coverage(entities: DataFrame, appearances: DataFrame) -> DataFrame:
    """One row: all entities, those that appear in a unit, their share."""
    seen = appearances.select("entity_id").distinct().withColumn("seen", F.lit(1))
    out = entities.join(seen, "entity_id", "left").agg(F.count("*").alias("total"), F.count("seen").alias("covered"))
    return out.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 4))


def basis_hash(claims: DataFrame, key: str) -> DataFrame:
    """(key, basis): 16 hex digits that name the set of live claims about each key; what a stored note is compared with."""
    ids = F.array_join(F.array_sort(F.collect_set("claim_id")), "|")
    return claims.groupBy(key).agg(F.substring(F.sha1(ids), 1, 16).alias("basis"), F.count_distinct("claim_id").alias("basis_size"))


def picked_claims(metrics: DataFrame, claims: DataFrame, entity: str, most: int = 48, per_edge: int = 2) -> DataFrame:
    """The claims that a note about ``entity`` cites: the first of each edge from the strongest on, then the second of each, up to ``most``."""
    mine = metrics.where((F.col("src") == entity) | (F.col("dst") == entity)).select(*EDGE, "weight")
    w = Window.partitionBy(*EDGE).orderBy("ch", "claim_id")
    facts = claims.where((F.col("src") == entity) | (F.col("dst") == entity)).join(mine, EDGE).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_edge)
    return facts.orderBy("turn", F.desc("weight"), *EDGE, "claim_id").limit(most).select("claim_id", "turn", *EDGE, "weight")
