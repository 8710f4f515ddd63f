"""Neighbourhoods, recommendations, shortest paths, components and communities over edge tables.

Iteration is driven by DataFrames: a frontier or label table is joined with the edges in each round, and only counts reach the
driver. Edges are (src, dst, weight) with any number of parallel ones; both directions count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillgraph.plans.storage import stored


def both_ways(edges: DataFrame) -> DataFrame:
    """(x, y, weight) in both directions, loops left out."""
    e = edges.where("src <> dst")
    w = F.coalesce("weight", F.lit(0.5)).alias("weight")
    return e.select(F.col("src").alias("x"), F.col("dst").alias("y"), w).unionByName(e.select(F.col("dst").alias("x"), F.col("src").alias("y"), w))


def ego(edges: DataFrame, center: str, depth: int = 1, limit: int = 300) -> DataFrame:
    """(entity_id, hop, strength): the centre and, hop by hop, the neighbours with the largest summed weight, ``limit`` in all.

    Depth is clamped to 1..2 and the limit to 2000, so the frontier is bounded and is broadcast.
    """
    spark, room = edges.sparkSession, min(limit, 2000) - 1
    pairs = both_ways(edges)
    seen = spark.createDataFrame([(center, 0, 0.0)], "entity_id STRING, hop INT, strength DOUBLE")
    for hop in range(1, min(max(depth, 1), 2) + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select(F.col("entity_id").alias("x"))
        near = pairs.join(F.broadcast(frontier), "x").groupBy(F.col("y").alias("entity_id")).agg(F.round(F.sum("weight"), 4).alias("strength"))
        new = near.join(F.broadcast(seen.select("entity_id")), "entity_id", "left_anti").orderBy(F.desc("strength"), "entity_id").limit(room)
        seen = stored(seen.unionByName(new.select("entity_id", F.lit(hop).alias("hop"), "strength")), "ego")
        room = min(limit, 2000) - seen.count()
        if room <= 0:
            break
    return seen


def edges_among(edges: DataFrame, ids: DataFrame, min_confidence: float = 0.0, predicates: list[str] | None = None) -> DataFrame:
    """Edges with both ends among ``ids`` (entity_id)."""
    out = edges.where(F.col("confidence") >= min_confidence)
    if predicates:
        out = out.where(F.col("predicate").isin(predicates))
    key = ids.select("entity_id").distinct()
    return out.join(key.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(key.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def shared_neighbours(edges: DataFrame, center: Column | str) -> DataFrame:
    """(entity_id, z, degree), stored: those that aren't neighbours of ``center`` but share the neighbour z with it, and how many neighbours z has.

    Only edges of the centre's neighbours are told apart and counted; the others are read but not shuffled.
    """
    pairs = both_ways(edges.select("src", "dst", F.lit(1.0).alias("weight"))).select("x", "y")
    mine = stored(pairs.where(F.col("x") == center).select(F.col("y").alias("z")).distinct(), "related-mine")
    near = stored(pairs.withColumnRenamed("x", "z").join(mine, "z", "left_semi").distinct(), "related-near")
    degree = near.groupBy("z").agg(F.count(F.lit(1)).alias("degree"))
    far = near.where(F.col("y") != center).withColumnRenamed("y", "entity_id").join(mine.withColumnRenamed("z", "entity_id"), "entity_id", "left_anti")
    return stored(far.join(degree, "z").select("entity_id", "z", "degree"), "related-shared")


def related(edges: DataFrame, center: Column | str, limit: int = 8, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """(entity_id, score, shared): not neighbours of ``center`` but sharing neighbours with it; rare shared neighbours weigh more (1 / ln(degree + 1)).

    With ``named``, ids are made of the edges' ids before they are ranked.
    """
    scored = shared_neighbours(edges, center).groupBy("entity_id").agg(F.round(F.sum(1 / F.log(F.col("degree") + 1)), 4).alias("score"), F.count("*").alias("shared"))
    scored = scored.withColumn("entity_id", named(F.col("entity_id"))) if named else scored
    return scored.orderBy(F.desc("score"), F.desc("shared"), "entity_id").limit(min(limit, 20))


def shortest_paths(edges: DataFrame, start: str, goal: str, max_hops: int = 3, top: int = 3) -> DataFrame:
    """(path, hops, score): the ``top`` best of all shortest undirected paths of at most ``max_hops``; the score is the mean of the best weight of each hop.

    A breadth-first search from the start finds each node's distance; paths are then followed back from the goal along falling
    distances, so only nodes on shortest paths are joined again.
    """
    spark = edges.sparkSession
    pairs = both_ways(edges)
    levels = spark.createDataFrame([(start, 0)], "n STRING, d INT")
    found = 0
    for hop in range(1, max(max_hops, 1) + 1):
        frontier = levels.where(F.col("d") == hop - 1).select(F.col("n").alias("x"))
        new = pairs.join(frontier, "x").select(F.col("y").alias("n")).distinct().join(levels, "n", "left_anti")
        levels = stored(levels.unionByName(new.withColumn("d", F.lit(hop))), "bfs")
        if levels.where((F.col("n") == goal) & (F.col("d") == hop)).limit(1).count():
            found = hop
            break
    paths = spark.createDataFrame([(goal, [goal], 0.0)], "head STRING, path ARRAY<STRING>, total DOUBLE").where(F.lit(found > 0))
    for hop in range(found - 1, -1, -1):
        level = levels.where(F.col("d") == hop).select(F.col("n").alias("y"))
        heads = paths.select(F.col("head").alias("x")).distinct()
        best = pairs.join(heads, "x").join(level, "y").groupBy("x", "y").agg(F.max("weight").alias("w"))
        paths = paths.join(best.select(F.col("x").alias("head"), "y", "w"), "head").select(F.col("y").alias("head"), F.concat(F.array("y"), "path").alias("path"), (F.col("total") + F.col("w")).alias("total"))
    scored = paths.select(F.array_join("path", ">").alias("path"), F.lit(found).alias("hops"), F.round(F.col("total") / max(1, found), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "path").limit(top)


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (a, b): the smallest reachable node, by label propagation with jumps.

    Labels are joined by a shuffle however small they are: sent to all tasks in every round, they would add up in the driver.
    """
    both = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        hooked = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = stored(hooked.join(roots.hint("merge"), "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component")), "cc-labels")
        labels = new.select("node", "component")
        if not new.where("component <> old").limit(1).count():
            return labels


def cycles(directed: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components with more than one node.

    Forward-backward trimming: nodes without a predecessor or successor in what is left can't be on a cycle and go; labels then
    spread along and against the edges until each node knows the smallest label that reaches it and that it reaches. Where both
    are the same node, they share that node's component; these leave, and the rest goes on.
    """
    rest = stored(directed.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    done: DataFrame | None = None
    while True:  # the smallest node that is left finds its component in each round
        while True:  # trim
            before = rest.count()
            kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            rest = stored(kept.select("src", "dst"), "scc-edges")
            if rest.count() == before:
                break
        if not before:
            break
        down, up = _spread(rest, "src", "dst"), _spread(rest, "dst", "src")
        both = down.join(up.withColumnRenamed("label", "up"), "node")
        found = stored(both.where("label = up").select("node", F.col("label").alias("component")), "scc-found")
        done = found if done is None else done.unionByName(found)
        # an edge stays if its ends are left and could still be in one component
        left = both.where("label <> up")
        a = left.select(F.col("node").alias("src"), F.col("label").alias("l1"), F.col("up").alias("u1"))
        b = left.select(F.col("node").alias("dst"), F.col("label").alias("l2"), F.col("up").alias("u2"))
        rest = stored(rest.join(a, "src").join(b, "dst").where("l1 = l2 AND u1 = u2").select("src", "dst"), "scc-edges")
    if done is None:
        return directed.select(F.col("src").alias("node"), F.col("src").alias("component")).where(F.lit(False))
    sizes = done.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return done.join(sizes, "component").select("node", "component")


def _spread(edges: DataFrame, tail: str, head: str) -> DataFrame:
    """(node, label): the smallest node from which each node is reached along tail -> head."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = stored(nodes.withColumn("label", F.col("node")), "scc-labels")
    while True:
        got = edges.join(labels.select(F.col("node").alias(tail), "label"), tail).groupBy(F.col(head).alias("node")).agg(F.min("label").alias("m"))
        new = stored(labels.join(got, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")), "scc-labels")
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def communities(graph: DataFrame, rise: float = 0.05) -> DataFrame:
    """(node, community) by Louvain (resolution 1) over an undirected graph (a, b, weight); a community is named by one of its nodes.

    In a level, nodes move to the neighbouring community with the largest gain in modularity, until none would or a round raises the modularity by less
    than ``rise`` of what the level has brought; communities then become the nodes of the next level, until the modularity doesn't grow.
    The moves of a round are made at once; of two nodes that stand alone and would join each other, the one of the larger name goes. Moves that make the
    modularity smaller are undone; if the level has brought nothing yet, half as many nodes by a hash are tried, down to single ones. Deterministic; ties go to the smaller name.
    Everything is a join or a sum by node and community; labels are shuffled, as sent to all tasks in every round they would add up in the driver.
    """
    ways = F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    links = graph.where("a <> b").select("a", "b", F.col("weight").cast("double").alias("weight")).select(F.inline(ways))
    names = None
    if dict(graph.dtypes)["a"] not in ("int", "bigint"):
        # nodes become numbers in the order of their names, so rows are narrow and ties stay as they are
        links = stored(links, "louvain-named")
        names = stored(links.select(F.col("a").alias("name")).distinct().orderBy("name").withColumn("node", F.monotonically_increasing_id()), "louvain-names")
        na, nb = (names.select(F.col("name").alias(x), F.col("node").alias("n" + x)) for x in "ab")
        links = links.join(na, "a").join(nb, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight")
    links = _links(links)
    total = links.agg(F.sum("weight")).first()[0] or 0.0  # twice the weight of all edges
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct()
    before, level = None, 0
    while total:
        moved, now = _moved(links, total, level, rise)
        if before is not None and now - before < 1e-9:  # sums in another order differ by less
            break
        up = moved.select(F.col("node").alias("community"), F.col("community").alias("higher"))
        labels = stored(labels.join(up, "community").select("node", F.col("higher").alias("community")), "louvain-labels")
        ca, cb = (moved.select(F.col("node").alias(x), F.col("community").alias("c" + x)) for x in "ab")
        links = _links(links.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "weight"))
        before, level = now, level + 1
    if names is None:
        return labels
    spelled = names.select(F.col("node").alias("community"), F.col("name").alias("called"))
    return labels.join(names, "node").join(spelled, "community").select(F.col("name").alias("node"), F.col("called").alias("community"))


def _links(links: DataFrame) -> DataFrame:
    """(a, b, weight, k), stored: links with the same ends summed, and the weight of all links of ``a``; dealt by ``a`` once for both."""
    summed = links.repartition("a").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return stored(summed.withColumn("k", F.sum("weight").over(Window.partitionBy("a"))), "louvain-links")


def _moved(links: DataFrame, total: float, level: int, rise: float) -> tuple[DataFrame, float]:
    """(node, community) after the moves of one level, and its modularity; ``links`` (a, b, weight, k) hold both directions, and loops."""
    between = links.where("a <> b")
    nodes = links.groupBy(F.col("a").alias("node")).agg(F.first("k").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("loop"))
    labels = stored(nodes.select("node", "k", "loop", F.col("node").alias("community"), F.xxhash64("node", F.lit(level)).alias("mark")), "louvain-nodes")
    share, start, held, best, open_ = 1.0, None, None, -1.0, 0
    while True:
        seen = Observation()  # counted while the round is written
        inner, square = F.sum(F.col("to") + F.col("loop")), F.sum(F.col("k") * F.col("all"))
        choices = stored(_choices(between, labels, total).observe(seen, inner.alias("inner"), square.alias("square"), F.count_if(F.col("best") != F.col("old")).alias("wishes")), "louvain-moves")
        now, wishes = seen.get["inner"] / total - seen.get["square"] / (total * total), seen.get["wishes"]
        start = now if start is None else start
        gained = now - best
        if held is None or gained > 1e-12:
            held, best, open_ = choices, now, wishes
            if not wishes or gained < rise * (now - start):
                break
        else:
            share /= 2
            if best > start or share * open_ < 1:
                break
        # marks are hashed again in each round, so a round's code is that of the last one
        mark = F.xxhash64("mark")
        goes = (F.pmod(mark, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) & ((F.col("best") < F.col("old")) | ~(F.col("alone") & F.col("best_alone")))
        labels = held.select("node", "k", "loop", F.when(goes, F.col("best")).otherwise(F.col("old")).alias("community"), mark.alias("mark"))
    return held.select("node", F.col("old").alias("community")), best


def _choices(between: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """Each node's community (old) with its weight (all) and the node's links to it (to), and the community that it gains most by (best).

    Links meet the labels of their far ends and are dealt by node once; a node's own label comes along as a link of no weight, so to stay is a choice as well.
    """
    sums = labels.groupBy("community").agg(F.sum("k").alias("all"), (F.count(F.lit(1)) == 1).alias("alone"))
    known = labels.join(sums.hint("shuffle_hash"), "community")
    near = between.join(known.select(F.col("node").alias("b"), "community", "all", "alone").hint("shuffle_hash"), "b").select(F.col("a").alias("node"), "k", "community", "all", "alone", "weight")
    own = known.select("node", "k", "community", "all", "alone", F.lit(0.0).alias("weight"), "loop", "mark")
    dealt = near.unionByName(own, allowMissingColumns=True).repartition("node")
    offers = dealt.groupBy("node", "community").agg(F.sum("weight").alias("to"), *(F.max(c).alias(c) for c in ("k", "all", "alone", "loop", "mark")))
    same = F.col("mark").isNotNull()
    gain = F.round((F.col("to") - F.col("k") * (F.col("all") - F.when(same, F.col("k")).otherwise(0.0)) / total) / total, 12)
    option = F.min(F.struct((-gain).alias("less"), (~same).alias("new"), "community", "alone"))
    mine = {"old": "community"} | {c: c for c in ("to", "all", "alone", "loop", "mark")}
    return offers.groupBy("node").agg(F.max("k").alias("k"), option["community"].alias("best"), option["alone"].alias("best_alone"), *(F.max(F.when(same, F.col(v))).alias(c) for c, v in mine.items()))


def community_profiles(graph: DataFrame, labels: DataFrame, claims: DataFrame, degrees: DataFrame, least: int = 3, members: int = 10, words: int = 6, samples: int = 8, shown: Callable[[DataFrame], DataFrame] | None = None, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, key, size, members, first_chapter, last_chapter, claims, predicates, evidence): communities of ``least`` nodes or more, the largest first.

    Members are the strongest by weighted degree; chapters, predicates and the surest evidence are those of claims within. The
    key is the digest of the first five members, so it survives a new numbering. Claims that travel with coded columns are
    ``shown`` (predicate, claim_id, evidence) once those within a community are stored; labels and degrees are by the claims' ids,
    and so are members, unless ``named`` makes ids of them before they are ranked.
    """
    sized = labels.join(labels.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least), "community")
    w = Window.partitionBy("community").orderBy(F.desc("weighted_degree"), "node")
    ranked = sized.join(degrees.select(F.col("entity_id").alias("node"), "weighted_degree"), "node", "left").fillna({"weighted_degree": 0.0})
    ranked = (ranked.withColumn("node", named(F.col("node"))) if named else ranked).withColumn("r", F.row_number().over(w))
    top = ranked.where(F.col("r") <= members).groupBy("community").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("r", "node")))["node"].alias("members"))
    a, b = (labels.select(F.col("node").alias(x), F.col("community").alias("c" + x)) for x in ("src", "dst"))
    inner = stored(claims.join(a, "src").join(b, "dst").where("csrc = cdst").drop("cdst").withColumnRenamed("csrc", "community"), "claims-within")
    inner = shown(inner) if shown else inner
    told = stored(inner.groupBy("community", "predicate").agg(F.count("*").alias("n"), F.min("ch").alias("lo"), F.max("ch").alias("hi")), "claims-told")
    spans = told.groupBy("community").agg(F.min("lo").alias("first_chapter"), F.max("hi").alias("last_chapter"), F.sum("n").alias("claims"))
    kinds = told.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "predicate"))).where(F.col("r") <= words)
    kinds = kinds.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("r", "predicate")))["predicate"].alias("predicates"))
    best = inner.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("confidence"), "ch", "claim_id"))).where(F.col("r") <= samples)
    best = best.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("r", "evidence")))["evidence"].alias("evidence"))
    out = top.join(spans, "community", "left").join(kinds, "community", "left").join(best, "community", "left")
    key = F.md5(F.array_join(F.array_sort(F.slice("members", 1, 5)), "|"))
    number = F.row_number().over(Window.orderBy(F.desc("size"), "community"))  # a row a community
    return out.select(number.alias("id"), key.alias("key"), "size", "members", "first_chapter", "last_chapter", F.coalesce("claims", F.lit(0)).alias("claims"), "predicates", "evidence")


def modularity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity): how much heavier edges within communities are than by chance."""
    e = stored(_ends(graph, labels).groupBy("ca", "cb").agg(F.sum("weight").alias("weight")), "community-weights")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    inside = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inner"))
    square = ends.agg(F.sum(F.col("d") * F.col("d")).alias("sq"))
    return inside.crossJoin(square).select(F.round(F.col("inner") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def _ends(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b, weight) with the communities of both ends, ca and cb."""
    return graph.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")


def hubs(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity_id, weighted_degree, community_span, hub_score): strength relative to the strongest, raised by the number of neighbouring communities.

    Each edge meets both labels once and tells either end of the other's community.
    """
    told = F.array(F.struct(F.col("a").alias("entity_id"), F.col("cb").alias("community"), "weight"), F.struct(F.col("b").alias("entity_id"), F.col("ca").alias("community"), "weight"))
    near = _ends(graph, labels).select(F.inline(told)).groupBy("entity_id", "community").agg(F.sum("weight").alias("weight"))
    span = stored(near.groupBy("entity_id").agg(F.round(F.sum("weight"), 4).alias("weighted_degree"), F.count("community").alias("community_span")), "hub-spans")
    top = span.agg(F.greatest(F.max("weighted_degree"), F.lit(1.0)).alias("top"))
    return span.crossJoin(F.broadcast(top)).select("entity_id", "weighted_degree", "community_span", F.round(F.col("weighted_degree") / F.col("top") * (1 + F.log(1 + F.col("community_span"))), 4).alias("hub_score"))


def across(metrics: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends are in different communities, with src_community and dst_community."""
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("src_community")), labels.select(F.col("node").alias("dst"), F.col("community").alias("dst_community"))
    return metrics.join(a, "src").join(b, "dst").where("src_community <> dst_community")


def strongest(edges: DataFrame, most: int = 3000) -> DataFrame:
    """The ``most`` strongest edges, numbered by ``id``."""
    top = edges.orderBy(F.desc("weight"), "src", "predicate", "dst").limit(most)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("weight"), "src", "predicate", "dst")))


def bridges(metrics: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """Edges whose ends are in different communities, the ``most`` strongest."""
    return strongest(across(metrics, labels), most)
