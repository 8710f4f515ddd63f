"""Views over several graphs and readers: search in all graphs, filters of a people's map, explained recommendations, names by language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.graph import shared_neighbours


def search_all(entities: DataFrame, keyword: str, each: int = 5, graph: str = "graph_id") -> DataFrame:
    """The first ``each`` hits (20 at most) of every graph: exact, prefix, other; then by claims and id. A blank keyword finds nothing."""
    kw = keyword.strip()
    hits = entities.where(F.contains(F.lower("name"), F.lit(kw.lower())) & F.lit(bool(kw)))
    grade = F.when(F.col("name") == kw, 0).when(F.col("name").startswith(kw), 1).otherwise(2)
    r = F.row_number().over(Window.partitionBy(graph).orderBy(grade, F.desc("claim_count"), "entity_id"))
    return hits.withColumn("rank", r).where(F.col("rank") <= min(each, 20))


def hubs_by_type(scores: DataFrame, each: int = 30) -> DataFrame:
    """The strongest hubs (entity_id, entity_type, hub_score) of each type, and of all types together as type '', with their rank."""
    typed = scores.unionByName(scores.withColumn("entity_type", F.lit("")))
    r = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("hub_score"), "entity_id"))
    return typed.where("hub_score IS NOT NULL").withColumn("rank", r).where(F.col("rank") <= each)


def visible(nodes: DataFrame, links: DataFrame, *, focus: str | None = None, years: tuple[int, int] | None = None, hidden: list[str] | None = None, carried: dict[str, str] | None = None) -> DataFrame:
    """Nodes (entity_id, kind, year) that a map shows under its filters; links are (src, dst, kind).

    With a ``focus`` only it and its neighbours; nodes outside the ``years`` go, but not the focus, nor those without a year (null or 0).
    If kinds of links are ``hidden``, nodes go all of whose links are hidden; nodes without links stay. Nodes of a kind in
    ``carried`` go with that kind of link alone.
    """
    out = nodes
    if focus is not None:
        near = links.where((F.col("src") == focus) | (F.col("dst") == focus)).select(F.explode(F.array("src", "dst")).alias("entity_id"))
        out = out.join(near.unionByName(links.sparkSession.createDataFrame([(focus,)], "entity_id STRING")).distinct(), "entity_id", "left_semi")
    if years is not None:
        dated = F.coalesce("year", F.lit(0)) != 0
        out = out.where(~dated | F.col("year").between(*years) | F.coalesce(F.col("entity_id") == focus, F.lit(False)))
    if hidden:
        shown = ~F.coalesce(F.col("kind").isin(hidden), F.lit(False))
        seen = links.select(F.explode(F.array("src", "dst")).alias("entity_id"), shown.alias("shown")).groupBy("entity_id").agg(F.max("shown").alias("any_shown"))
        gone_kinds = [k for k, link in (carried or {}).items() if link in hidden]
        own = F.coalesce(F.col("kind").isin(list(carried or {})), F.lit(False))
        out = out.join(seen, "entity_id", "left").where(F.when(own, ~F.col("kind").isin(gone_kinds)).otherwise(F.coalesce("any_shown", F.lit(True)))).drop("any_shown")
    return out


def related_because(edges: DataFrame, center: Column | str, limit: int = 8, reasons: int = 2, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """(entity_id, score, shared, via): recommendations as ``graph.related`` gives them, with the shared neighbours that weigh most (the rarest, ties by id)."""
    open_ = shared_neighbours(edges, center)
    top = open_.groupBy("entity_id").agg(F.round(F.sum(1 / F.log(F.col("degree") + 1)), 4).alias("score"), F.count(F.lit(1)).alias("shared"))
    if named:
        open_, top = open_.withColumns({c: named(F.col(c)) for c in ("entity_id", "z")}), top.withColumn("entity_id", named(F.col("entity_id")))
    top = top.orderBy(F.desc("score"), F.desc("shared"), "entity_id").limit(min(limit, 20))
    why = open_.join(F.broadcast(top), "entity_id").withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("degree", "z"))).where(F.col("r") <= reasons)  # at most 20 rows
    return why.groupBy("entity_id", "score", "shared").agg(F.sort_array(F.collect_list(F.struct("r", "z")))["z"].alias("via"))


def localized(rows: DataFrame, words: DataFrame, locale: str, code: str, name: str) -> DataFrame:
    """``rows`` with the display ``name`` of a locale where ``words`` (code, locale, shown) has one for the ``code``; of several the first by text."""
    mine = words.where((F.col("locale") == locale) & F.col("shown").isNotNull()).groupBy(F.col("code").alias("_code")).agg(F.min("shown").alias("_shown"))
    return rows.join(mine, F.col(code) == F.col("_code"), "left").withColumn(name, F.coalesce("_shown", name)).drop("_code", "_shown")


def kept_points(points: DataFrame, cluster: Column | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Points of a chosen cluster, and the hits of a search (id) wherever they are; all, if neither is given."""
    if cluster is None and hits is None:
        return points
    chosen = F.coalesce(cluster, F.lit(False)) if cluster is not None else F.lit(False)
    if hits is None:
        return points.where(chosen)
    marked = points.join(hits.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return marked.where(chosen | F.coalesce("_hit", F.lit(False))).drop("_hit")
