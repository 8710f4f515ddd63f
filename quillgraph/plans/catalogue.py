"""The registered queries of the graph engine over the driver tables, and their SQL.

Names tell the family: a claims and edges, b graph, c rules, d review, e text and pages, f vectors, g view models, h events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import codes
from quillgraph.operators import edges, flows, graph, review, rules, text, vectors
from quillgraph.plans.harness import SQL, Tables, code_of, named, spelled
from quillgraph.plans.storage import stored
from quillgraph.sources import pages
from quillgraph.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
POSITIVE, HOSTILE = ["ORDERED"], ["RETURNED"]
#: The person and the part that point queries ask for.
PERSON, OTHER = "c:7", "c:11"


def query(name: str, sql: str | None = None, model: bool = True):
    """Register a function of Tables; ``sql`` follows the graph model's views unless ``model`` is off."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = f"{SQL}{sql}" if model else sql
        return fn

    return add


EDGE_SQL = """, edge AS (
  SELECT src, predicate, dst, count(*) AS support_count, max(confidence) AS confidence, avg(confidence) AS confidence_avg, min(ch) AS first_chapter, max(ch) AS last_chapter, count(DISTINCT ch) AS archive_count
  FROM live GROUP BY src, predicate, dst
), co AS (
  SELECT e.src, e.dst, count(*) AS co_mention FROM (SELECT DISTINCT src, dst FROM edge) e JOIN appear a ON a.entity_id = e.src JOIN appear b ON b.entity_id = e.dst AND b.ch = a.ch GROUP BY e.src, e.dst
), scored AS (
  SELECT edge.*, coalesce(co_mention, 0) AS co_mention, round(ln(1 + support_count) + 1.2 * ln(1 + archive_count) + 0.5 * ln(1 + coalesce(co_mention, 0)) + confidence_avg, 9) AS raw
  FROM edge LEFT JOIN co USING (src, dst)
), metric AS MATERIALIZED (
  SELECT src, predicate, dst, support_count AS claim_count, archive_count, co_mention, round(confidence_avg, 4) AS confidence_avg, confidence, first_chapter, last_chapter, round(cume_dist() OVER (ORDER BY raw), 4) AS weight FROM scored
)"""


def unit_table(t: Tables) -> DataFrame:
    """(entity_id coded, first, units) of all entities, stored."""
    return stored(edges.entity_units(t.coded_places), "entity-units")


def coded_metrics(t: Tables, units: DataFrame | None = None) -> DataFrame:
    """The metrics with ids and predicates as numbers. The relations behind it are stored, so it can be read several times."""
    return edges.edge_metrics(t.coded_claims.where("live"), unit_table(t) if units is None else units)


def metrics(t: Tables) -> DataFrame:
    return spelled(coded_metrics(t), "src", "dst")


@query("a_edge_strength_top", EDGE_SQL + " SELECT src, predicate, dst, claim_count, co_mention, weight FROM metric ORDER BY weight DESC, src, predicate, dst LIMIT 30")
def _(t):
    return metrics(t).select("src", "predicate", "dst", "claim_count", "co_mention", "weight").orderBy(F.desc("weight"), "src", "predicate", "dst").limit(30)


@query("a_edge_metrics", EDGE_SQL + " SELECT * FROM metric")
def _(t):
    return metrics(t)


@query("a_claim_dedup", " SELECT src, predicate, dst, ch, count(*) AS mentions, max(confidence) AS confidence, min(evidence) AS evidence FROM claim GROUP BY src, predicate, dst, ch")
def _(t):
    return edges.deduplicated(t.claims)


@query("a_edges", EDGE_SQL + ", listed AS (SELECT src, predicate, dst, string_agg(ch, ',' ORDER BY ch) AS chapters FROM (SELECT DISTINCT src, predicate, dst, ch FROM live) GROUP BY src, predicate, dst) SELECT src, predicate, dst, support_count, chapters, confidence, first_chapter, last_chapter FROM edge JOIN listed USING (src, predicate, dst)")
def _(t):
    return edges.edges(t.live).drop("confidence_avg").withColumn("chapters", F.array_join(F.transform("chapters", lambda c: c.cast("string")), ","))


@query("a_symmetric", " SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS n FROM claim WHERE predicate = 'KILLED' GROUP BY 1, 2")
def _(t):
    return edges.counts_by(edges.symmetric(t.claims.where("predicate = 'KILLED'"), ["KILLED"]), "src", "dst")


@query("a_claim_counts", " SELECT entity_id, count(*) AS claim_count FROM (SELECT src AS entity_id FROM live UNION ALL SELECT dst FROM live) GROUP BY entity_id")
def _(t):
    return edges.claim_counts(t.live)


STATS_SQL = """, counted AS (SELECT entity_id, count(*) AS claim_count FROM (SELECT src AS entity_id FROM live UNION ALL SELECT dst FROM live) GROUP BY entity_id),
seen AS (SELECT entity_id, min(ch) AS first_chapter, max(ch) AS last_chapter, count(*) AS chapter_count, CAST(sum(n) AS BIGINT) AS mention_count FROM appear GROUP BY entity_id),
stat AS (SELECT ent.*, first_chapter, last_chapter, chapter_count, mention_count, coalesce(claim_count, 0) AS claim_count FROM ent LEFT JOIN seen USING (entity_id) LEFT JOIN counted USING (entity_id) WHERE coalesce(claim_count, 0) > 0 OR is_hero)"""


def statistics(t: Tables) -> DataFrame:
    return edges.entity_statistics(t.entities, t.live, t.appearances)


@query("a_entity_statistics", STATS_SQL + " SELECT * FROM stat")
def _(t):
    return statistics(t)


@query("a_type_counts", " SELECT entity_type, count(*) AS n FROM ent GROUP BY entity_type")
def _(t):
    return edges.counts_by(t.entities, "entity_type")


@query("a_predicate_status_counts", " SELECT predicate, status, count(*) AS n FROM claim GROUP BY predicate, status")
def _(t):
    return edges.counts_by(t.claims, "predicate", "status")


@query("a_predicate_rollup", " SELECT coalesce(predicate, 'all') AS predicate, coalesce(status, 'all') AS status, count(*) AS n FROM claim GROUP BY ROLLUP (predicate, status)")
def _(t):
    return t.claims.rollup("predicate", "status").agg(F.count("*").alias("n")).withColumns({c: F.coalesce(c, F.lit("all")) for c in ("predicate", "status")})


@query("a_totals", " SELECT (SELECT count(DISTINCT ch) FROM claim) AS units, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM claim) AS claims, (SELECT count(*) FROM appear) AS mentions")
def _(t):
    one = t.claims.agg(F.count_distinct("ch").alias("units"), F.count("*").alias("claims"))
    return one.crossJoin(t.entities.agg(F.count("*").alias("entities"))).crossJoin(t.appearances.agg(F.count("*").alias("mentions"))).select("units", "entities", "claims", "mentions")


@query("a_coverage", " SELECT count(*) AS total, count(a.entity_id) AS covered, round(count(a.entity_id) / count(*), 4) AS ratio FROM ent LEFT JOIN (SELECT DISTINCT entity_id FROM appear) a USING (entity_id)")
def _(t):
    return edges.coverage(t.entities, t.appearances)


@query("a_span", " SELECT min(ch) AS lo, max(ch) AS hi, count(*) AS n FROM claim")
def _(t):
    return t.claims.agg(F.min("ch").alias("lo"), F.max("ch").alias("hi"), F.count("*").alias("n"))


@query("a_basis_hash", " SELECT src, substr(sha1(string_agg(claim_id, '|' ORDER BY claim_id)), 1, 16) AS basis, count(*) AS basis_size FROM (SELECT DISTINCT src, claim_id FROM live) GROUP BY src")
def _(t):
    return edges.basis_hash(t.live, "src")


@query("a_edge_keys", EDGE_SQL + " SELECT src || '::' || predicate || '::' || dst AS edge_key, weight FROM metric WHERE src IN ('c:7', 'c:11', 's:3')")
def _(t):
    return metrics(t).where(F.col("src").isin("c:7", "c:11", "s:3")).select(codes.edge_key(F.col("src"), F.col("predicate"), F.col("dst")).alias("edge_key"), "weight")


@query("a_picked_claims", EDGE_SQL + """, mine AS (SELECT src, predicate, dst, weight FROM metric WHERE src = 'c:7' OR dst = 'c:7'),
f AS (SELECT claim_id, live.src, live.predicate, live.dst, weight, row_number() OVER (PARTITION BY live.src, live.predicate, live.dst ORDER BY ch, claim_id) AS turn FROM live JOIN mine USING (src, predicate, dst))
SELECT claim_id, turn, src, predicate, dst, weight FROM f WHERE turn <= 2 ORDER BY turn, weight DESC, src, predicate, dst, claim_id LIMIT 48""")
def _(t):
    return edges.picked_claims(metrics(t), t.live, PERSON).withColumn("turn", F.col("turn").cast("long"))


UNDIRECTED_SQL = EDGE_SQL + ", und AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(weight), 6) AS weight FROM metric WHERE src <> dst GROUP BY 1, 2), way AS MATERIALIZED (SELECT src AS x, dst AS y, weight FROM metric WHERE src <> dst UNION ALL SELECT dst, src, weight FROM metric WHERE src <> dst)"


@query("b_weighted_degree", UNDIRECTED_SQL + " SELECT entity_id, round(sum(weight), 4) AS weighted_degree, count(*) AS degree FROM (SELECT a AS entity_id, weight FROM und UNION ALL SELECT b, weight FROM und) GROUP BY entity_id")
def _(t):
    return spelled(edges.weighted_degree(edges.undirected(coded_metrics(t))), "entity_id")


@query("b_degree", UNDIRECTED_SQL + " SELECT ent.entity_id, count(DISTINCT y) AS degree FROM ent LEFT JOIN way ON x = entity_id GROUP BY ent.entity_id")
def _(t):
    e = edges.edges(t.live).withColumn("weight", F.lit(1.0))
    return t.entities.select("entity_id").join(graph.both_ways(e).select(F.col("x").alias("entity_id"), "y"), "entity_id", "left").groupBy("entity_id").agg(F.count_distinct("y").alias("degree"))


@query("b_overview", STATS_SQL + " SELECT entity_id, name, claim_count FROM stat WHERE claim_count > 0 ORDER BY claim_count DESC, entity_id LIMIT 300")
def _(t):
    return statistics(t).where("claim_count > 0").select("entity_id", "name", "claim_count").orderBy(F.desc("claim_count"), "entity_id").limit(300)


EGO_SQL = UNDIRECTED_SQL + f""", h1 AS MATERIALIZED (SELECT y AS entity_id, 1 AS hop, round(sum(weight), 4) AS strength FROM way WHERE x = '{PERSON}' AND y <> '{PERSON}' GROUP BY y ORDER BY strength DESC, y LIMIT 99),
h2 AS MATERIALIZED (SELECT y AS entity_id, 2 AS hop, round(sum(weight), 4) AS strength FROM way JOIN h1 ON x = h1.entity_id WHERE y <> '{PERSON}' AND y NOT IN (SELECT entity_id FROM h1) GROUP BY y ORDER BY strength DESC, y LIMIT (SELECT 99 - count(*) FROM h1)),
near AS MATERIALIZED (SELECT '{PERSON}' AS entity_id, 0 AS hop, CAST(0 AS DOUBLE) AS strength UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""


@query("b_ego", EGO_SQL + " SELECT * FROM near")
def _(t):
    return graph.ego(metrics(t), PERSON, depth=2, limit=100)


@query("b_ego_edges", EGO_SQL + " SELECT src, predicate, dst, weight FROM metric WHERE src IN (SELECT entity_id FROM near) AND dst IN (SELECT entity_id FROM near) AND confidence >= 0.95")
def _(t):
    m = metrics(t)
    return graph.edges_among(m, graph.ego(m, PERSON, depth=2, limit=100), 0.95).select("src", "predicate", "dst", "weight")


RELATED_SQL = UNDIRECTED_SQL + f""", pair AS (SELECT DISTINCT x, y FROM way), mine AS (SELECT y AS z FROM pair WHERE x = '{PERSON}'), deg AS (SELECT x AS z, count(*) AS d FROM pair GROUP BY x)
SELECT y AS entity_id, round(sum(1 / ln(d + 1)), 4) AS score, count(*) AS shared FROM pair JOIN mine ON x = z JOIN deg USING (z) WHERE y <> '{PERSON}' AND y NOT IN (SELECT z FROM mine) GROUP BY y ORDER BY score DESC, shared DESC, entity_id LIMIT 20"""


@query("b_related", RELATED_SQL)
def _(t):
    return graph.related(t.coded_claims.where("live"), code_of(PERSON), 20, named=named)


@query("b_shortest_paths", UNDIRECTED_SQL + f""", best AS (SELECT x, y, max(weight) AS w FROM way GROUP BY x, y),
p1 AS (SELECT x || '>' || y AS path, 1 AS hops, w AS total FROM best WHERE x = '{PERSON}' AND y = '{OTHER}'),
p2 AS (SELECT a.x || '>' || a.y || '>' || b.y AS path, 2 AS hops, a.w + b.w AS total FROM best a JOIN best b ON a.y = b.x WHERE a.x = '{PERSON}' AND b.y = '{OTHER}' AND a.y NOT IN ('{PERSON}', '{OTHER}')),
p3 AS (SELECT a.x || '>' || a.y || '>' || b.y || '>' || c.y AS path, 3 AS hops, a.w + b.w + c.w AS total FROM best a JOIN best b ON a.y = b.x JOIN best c ON b.y = c.x
  WHERE a.x = '{PERSON}' AND c.y = '{OTHER}' AND a.y NOT IN ('{PERSON}', '{OTHER}') AND b.y NOT IN ('{PERSON}', '{OTHER}') AND a.y <> b.y),
every AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3), few AS (SELECT * FROM every WHERE hops = (SELECT min(hops) FROM every))
SELECT path, hops, round(total / hops, 4) AS score FROM few ORDER BY score DESC, path LIMIT 10""")
def _(t):
    return graph.shortest_paths(metrics(t), PERSON, OTHER, 3, 10)


@query("b_components")
def _(t):
    e = edges.edges(t.live.where("predicate = 'KILLED'")).where("src <> dst")
    return graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))


ORACLE["b_components"] = SQL.replace("WITH ent AS", "WITH RECURSIVE ent AS", 1) + """, e AS (SELECT DISTINCT src AS a, dst AS b FROM live WHERE predicate = 'KILLED' AND src <> dst), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, other) AS (SELECT a, a FROM u UNION SELECT a, b FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a)
SELECT node, min(other) AS component FROM r GROUP BY node"""


def _community(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, graph and communities, with ids as numbers."""
    m = coded_metrics(t)
    g = stored(edges.undirected(m), "graph")
    return m, g, graph.communities(g)


@query("b_communities")
def _(t):
    return spelled(_community(t)[2], "node", "community")


@query("b_modularity")
def _(t):
    _, g, labels = _community(t)
    return graph.modularity(g, labels)


@query("b_hubs")
def _(t):
    _, g, labels = _community(t)
    return spelled(graph.hubs(g, labels), "entity_id")


@query("b_bridges")
def _(t):
    m, _, labels = _community(t)
    found = spelled(graph.across(m, labels), "src", "dst", "src_community", "dst_community")
    return graph.strongest(found).select("dst", "src", *m.drop("src", "dst").columns, "src_community", "dst_community", "id")


RULE_COLUMNS = "rule, severity, anchor_id, other_id, claim_id, ch, measure"


@query("c_r1_reversal", """, tone AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b, predicate = 'ORDERED' AS good FROM live WHERE predicate IN ('ORDERED', 'RETURNED')),
p AS (SELECT a, b, min(struct_pack(ch := ch, claim_id := claim_id, src := src, dst := dst)) FILTER (good) AS fp, min(struct_pack(m := -ch, claim_id := claim_id, ch := ch)) FILTER (good) AS lp, min(struct_pack(m := -ch, claim_id := claim_id, ch := ch)) FILTER (NOT good) AS ln FROM tone GROUP BY a, b),
q AS (SELECT *, ln.ch > fp.ch AND ln.ch >= lp.ch AS turned FROM p WHERE fp IS NOT NULL AND ln IS NOT NULL)
SELECT 'R1' AS rule, CASE WHEN turned THEN 'high' ELSE 'medium' END AS severity, fp.src AS anchor_id, fp.dst AS other_id, CASE WHEN turned THEN ln.claim_id ELSE lp.claim_id END AS claim_id, CASE WHEN turned THEN ln.ch ELSE lp.ch END AS ch, ln.ch - fp.ch AS measure FROM q""")
def _(t):
    return rules.reversal(t.live, POSITIVE, HOSTILE)


@query("c_r2_after_death", """, d AS (SELECT dst AS victim, min(struct_pack(ch := ch, claim_id := claim_id, src := src)) AS d FROM live WHERE predicate = 'KILLED' GROUP BY dst),
g AS (SELECT victim, d.src AS killer, min(struct_pack(ch := ch, claim_id := claim_id)) AS c, count(*) AS n FROM d JOIN live ON live.src = victim WHERE predicate NOT IN ('KIN', 'NATIVE_OF') AND ch > d.ch + 1 GROUP BY victim, d.src)
SELECT 'R2' AS rule, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS severity, victim AS anchor_id, killer AS other_id, c.claim_id AS claim_id, c.ch AS ch, n AS measure FROM g""")
def _(t):
    return rules.after_death(t.live)


@query("c_r3_long_absence", """, s AS (SELECT appear.entity_id, ch, lag(ch) OVER (PARTITION BY appear.entity_id ORDER BY ch) AS before FROM appear JOIN ent ON ent.entity_id = appear.entity_id WHERE is_hero),
g AS (SELECT entity_id, min(struct_pack(m := before - ch, ch := ch)) AS g FROM s WHERE before IS NOT NULL GROUP BY entity_id),
k AS (SELECT entity_id, -g.m AS len, g.ch AS back FROM g WHERE -g.m >= 20),
c AS (SELECT k.entity_id, min(claim_id) AS claim_id FROM k JOIN live ON live.ch = k.back AND (live.src = k.entity_id OR live.dst = k.entity_id) GROUP BY k.entity_id)
SELECT 'R3' AS rule, CASE WHEN len >= 36 THEN 'medium' ELSE 'low' END AS severity, k.entity_id AS anchor_id, '' AS other_id, coalesce(claim_id, '') AS claim_id, back AS ch, len - 1 AS measure FROM k LEFT JOIN c USING (entity_id)""")
def _(t):
    return rules.long_absence(t.entities, t.appearances, t.live)


@query("c_r4_functional_conflict", """, v AS (SELECT live.src, live.predicate, live.dst, ent.name, ch, claim_id FROM live JOIN ent ON ent.entity_id = live.dst WHERE predicate = 'RETURNED'),
n AS (SELECT DISTINCT src, predicate, name FROM v), kept AS (SELECT src, predicate, count(*) AS measure FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.src = n.src AND m.name <> n.name AND contains(m.name, n.name)) GROUP BY src, predicate),
g AS (SELECT src, predicate, min(struct_pack(m := -ch, claim_id := claim_id, ch := ch)) AS c FROM v GROUP BY src, predicate HAVING count(DISTINCT dst) > 1)
SELECT 'R4' AS rule, 'medium' AS severity, src AS anchor_id, predicate AS other_id, c.claim_id AS claim_id, c.ch AS ch, measure FROM g JOIN kept USING (src, predicate) WHERE measure > 1""")
def _(t):
    return rules.functional_conflict(t.live, t.entities, ["RETURNED"])


GAP_SQL = ", first AS (SELECT entity_id, min(ch) AS f FROM appear GROUP BY entity_id), gap AS (SELECT p.src, p.dst, min(p.ch) AS ch, any_value(a.f) AS fa, any_value(b.f) AS fb FROM prereq p JOIN first a ON a.entity_id = p.src JOIN first b ON b.entity_id = p.dst GROUP BY p.src, p.dst)"


@query("c_m1_inverted", GAP_SQL + " SELECT 'M1' AS rule, CASE WHEN fa - fb >= 10 THEN 'high' ELSE 'medium' END AS severity, dst AS anchor_id, src AS other_id, '' AS claim_id, ch, fa - fb AS measure FROM gap WHERE fa > fb")
def _(t):
    return rules.inverted_prerequisite(t.prerequisites, t.appearances)


@query("c_m2_cycles")
def _(t):
    return rules.prerequisite_cycles(t.prerequisites)


@query("c_m3_lonely", ", once AS (SELECT entity_id, min(ch) AS ch FROM appear GROUP BY entity_id HAVING count(*) = 1) SELECT 'M3' AS rule, 'low' AS severity, entity_id AS anchor_id, '' AS other_id, '' AS claim_id, ch, 1 AS measure FROM once WHERE entity_id NOT IN (SELECT src FROM prereq UNION SELECT dst FROM prereq) ORDER BY entity_id LIMIT 120")
def _(t):
    return rules.lonely(t.entities, t.appearances, t.prerequisites)


@query("c_m4_long_jump", GAP_SQL + " SELECT 'M4' AS rule, CASE WHEN fb - fa >= 10 THEN 'medium' ELSE 'low' END AS severity, src AS anchor_id, dst AS other_id, '' AS claim_id, ch, fb - fa AS measure FROM gap WHERE fb - fa >= 5")
def _(t):
    return rules.long_jump(t.prerequisites, t.appearances, gap_units=5)


@query("c_g1_surprising_links")
def _(t):
    from pyspark.sql import Window

    m, g, labels = _community(t)
    persons = spelled(graph.hubs(g, labels), "entity_id").join(t.entities.where("entity_type IN ('Person', 'Organization')").select("entity_id"), "entity_id", "left_semi")
    # rank by counting over score buckets: the order of a global window, without one
    top = edges.cumulative_share(persons.withColumn("key", -F.col("hub_score")), "key", "share")
    n = persons.count()
    return rules.surprising_links(spelled(m, "src", "dst"), spelled(labels, "node", "community"), top.select("entity_id", F.ceil(F.col("share") * n).cast("int").alias("rank_no")))


@query("c_s3_parallel_definitions", """, defs AS (SELECT live.src, live.dst, ent.name, ch, claim_id FROM live JOIN ent ON ent.entity_id = live.dst WHERE predicate = 'SUPPLIED'),
hit AS (SELECT name, dst, count(*) AS h FROM defs GROUP BY name, dst), anchor AS (SELECT name, min(struct_pack(m := -h, dst := dst)) AS a FROM hit GROUP BY name),
g AS (SELECT name, count(DISTINCT src) AS n, min(struct_pack(ch := ch, claim_id := claim_id)) AS c FROM defs GROUP BY name HAVING count(DISTINCT src) > 1)
SELECT 'S3' AS rule, CASE WHEN n >= 4 THEN 'medium' ELSE 'low' END AS severity, a.dst AS anchor_id, '' AS other_id, c.claim_id AS claim_id, c.ch AS ch, n AS measure FROM g JOIN anchor USING (name)""")
def _(t):
    return rules.parallel_definitions(t.live, t.entities, "SUPPLIED")


@query("c_anomaly_page")
def _(t):
    found = rules.reversal(t.live, POSITIVE, HOSTILE).unionByName(rules.after_death(t.live)).unionByName(rules.long_absence(t.entities, t.appearances, t.live))
    return rules.page(rules.anomaly_ids(found, "orders"), 50, 10)


LOW = 0.93
REVIEW_SQL = f""", many AS (SELECT src, predicate FROM live WHERE predicate = 'RETURNED' GROUP BY src, predicate HAVING count(DISTINCT dst) > 1),
reason AS (SELECT claim_id, 1 AS k, 'conflict' AS reason FROM live JOIN many USING (src, predicate) WHERE status = 'auto_verified' UNION SELECT claim_id, 2, 'low' FROM claim WHERE status = 'auto_verified' AND confidence < {LOW}),
decision AS (SELECT 'o:' || o_orderkey || ':1' AS claim_id FROM orders WHERE o_orderpriority = '1-URGENT'),
still AS (SELECT * FROM reason WHERE claim_id NOT IN (SELECT claim_id FROM decision))"""


def _review(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = review.candidates(conflict=review.conflicting(t.claims, ["RETURNED"]), low=review.low_confidence(t.claims, LOW))
    decided = t.read("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o:"), "o_orderkey", F.lit(":1")).alias("claim_id"))
    return found, decided


@query("d_review_queue", REVIEW_SQL + ", q AS (SELECT claim_id, string_agg(reason, ',' ORDER BY k) AS reasons, count(*) AS n, min(k) AS k FROM still GROUP BY claim_id) SELECT claim_id, reasons FROM q ORDER BY n DESC, k, claim_id LIMIT 20 OFFSET 20")
def _(t):
    return review.queue(*_review(t), limit=20, offset=20).select("claim_id", F.array_join("reasons", ",").alias("reasons"))


@query("d_review_counts", REVIEW_SQL + " SELECT reason, count(*) AS n FROM still GROUP BY reason")
def _(t):
    return review.open_counts(*_review(t))


@query("d_decisions_replayed", ", d AS (SELECT 'o:' || o_orderkey || ':1' AS claim_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'reject' ELSE 'confirm' END AS action FROM orders) SELECT predicate, CASE WHEN action = 'confirm' THEN 'human_verified' ELSE status END AS status, count(*) AS n FROM claim LEFT JOIN d USING (claim_id) WHERE coalesce(action, '') <> 'reject' GROUP BY 1, 2")
def _(t):
    d = t.read("orders").select(F.concat(F.lit("o:"), "o_orderkey", F.lit(":1")).alias("claim_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "reject").otherwise("confirm").alias("action"))
    return edges.counts_by(review.replayed(t.claims, d), "predicate", "status")


@query("d_decisions_folded", "SELECT user_id, last.event_type AS event_type FROM (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, event_type := event_type)) AS last FROM events GROUP BY user_id) WHERE last.event_type <> 'view'", model=False)
def _(t):
    return review.folded(t.read("events"), "user_id", ["ts", "event_id"], "event_type", "view")


@query("d_claim_page", " SELECT claim_id, ch FROM claim WHERE status = 'auto_verified' ORDER BY ch, claim_id LIMIT 20 OFFSET 40")
def _(t):
    return t.claims.where("status = 'auto_verified'").orderBy("ch", "claim_id").offset(40).limit(20).select("claim_id", "ch")


@query("d_claims_by_ids", " SELECT claim_id, src, dst, s.name AS subject, o.name AS object FROM live JOIN ent s ON s.entity_id = src JOIN ent o ON o.entity_id = dst WHERE claim_id IN ('o:1:1', 'u:1:1', 'o:7:2', 'r:3:1', 'h:5', 'o:32:7')")
def _(t):
    c = t.live.where(F.col("claim_id").isin("o:1:1", "u:1:1", "o:7:2", "r:3:1", "h:5", "o:32:7")).select("claim_id", "src", "dst")
    s, o = (t.entities.select(F.col("entity_id").alias(k), F.col("name").alias(n)) for k, n in (("src", "subject"), ("dst", "object")))
    return c.join(s, "src").join(o, "dst")


@query("d_files_registered", """WITH o AS (SELECT 'docs/' || doc_id AS path, sha1("text") AS sha1, doc_id, row_number() OVER (PARTITION BY sha1("text") ORDER BY 'docs/' || doc_id) AS turn FROM documents),
k AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE sha1 END AS sha1 FROM o WHERE doc_id % 3 = 0)
SELECT o.path, o.sha1, CASE WHEN k.sha1 = o.sha1 THEN 'unchanged' WHEN k.path IS NOT NULL THEN 'replaced' WHEN o.sha1 NOT IN (SELECT sha1 FROM k) AND turn = 1 THEN 'added' ELSE 'duplicate' END AS status FROM o LEFT JOIN k USING (path)""", model=False)
def _(t):
    docs = t.read("documents").select("doc_id", F.concat(F.lit("docs/"), "doc_id").alias("path"), F.sha1("text").alias("sha1"))
    known = docs.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("sha1")).alias("sha1"))
    return review.register_files(known, docs.select("path", "sha1"))


@query("d_upsert", "SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer", model=False)
def _(t):
    c = t.read("customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("v"))
    new = t.read("customer").where("c_nationkey < 5").select("c_custkey", "c_name", F.lit(0.0).alias("c_acctbal"), F.lit(2).alias("v"))
    return review.upsert(c, new, "c_custkey", "v").drop("v")


@query("e_keywords", r"""WITH w AS (SELECT doc_id, lang, unnest(list_filter(regexp_extract_all(lower("text"), '[a-z]+'), lambda x: length(x) >= 3)) AS word FROM documents),
p AS (SELECT doc_id, lang, word, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT word, count(*) AS df FROM p, n GROUP BY word, n.n HAVING count(*) >= 2 AND count(*) <= 0.35 * n.n),
tf AS (SELECT lang, word, sum(c) AS c, any_value(df) AS df FROM p JOIN df USING (word) GROUP BY lang, word),
k AS (SELECT lang, word, round(c / sum(c) OVER (PARTITION BY lang) * (ln((n.n + 1) / (df + 1)) + 1), 5) AS weight FROM tf, n)
SELECT * FROM (SELECT lang, word, weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank FROM k) WHERE rank <= 10""", model=False)
def _(t):
    return text.keywords(t.read("documents"), "lang")


@query("e_segments")
def _(t):
    return text.segments(t.read("documents").select("doc_id", "text"))


@query("e_windows", """WITH RECURSIVE par AS (SELECT doc_id, unnest(x) AS p, CAST(unnest(range(len(x))) AS INTEGER) AS i FROM (SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS x FROM documents)),
run AS (SELECT doc_id, i, CAST(length(p) AS BIGINT) AS size, 0 AS win FROM par WHERE i = 0
UNION ALL SELECT r.doc_id, q.i, CASE WHEN r.size > 0 AND r.size + length(q.p) > 2000 THEN length(q.p) ELSE r.size + length(q.p) END, CASE WHEN r.size > 0 AND r.size + length(q.p) > 2000 THEN win + 1 ELSE win END FROM run r JOIN par q ON q.doc_id = r.doc_id AND q.i = r.i + 1)
SELECT doc_id AS id, win AS "window", min(i) AS first, max(i) + 1 AS past FROM run GROUP BY doc_id, win""", model=False)
def _(t):
    return text.windows(t.read("documents").select("doc_id", "text"), limit=2000)


@query("e_name_counts", """WITH nm AS (SELECT 'n:' || n_nationkey AS entity_id, n_name AS name FROM nation UNION ALL SELECT 'w:' || w, w FROM (SELECT unnest(['the', 'they', 'les', 'der']) AS w)),
tok AS (SELECT doc_id AS id, unnest(regexp_split_to_array("text", '[^A-Za-z0-9]+')) AS name FROM documents) SELECT id, entity_id, count(*) AS n FROM tok JOIN nm USING (name) GROUP BY id, entity_id""", model=False)
def _(t):
    names = [(f"n:{r[0]}", r[1]) for r in t.read("nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    return text.name_counts(t.read("documents").select("doc_id", "text"), [*names, ("w:the", "the"), ("w:they", "they"), ("w:les", "les"), ("w:der", "der")])


@query("e_located", r"""WITH q AS (SELECT item_id, regexp_replace("text", '\s+', '', 'g') AS f FROM benchmark), p AS (SELECT item_id, substr(f, greatest(1, CAST(floor((length(f) - 40) / 2) AS INTEGER) + 1), 40) AS p FROM q WHERE f <> ''),
d AS (SELECT doc_id, regexp_replace("text", '\s+', '', 'g') AS f FROM documents)
SELECT item_id, min(doc_id) AS id FROM p JOIN d ON contains(d.f, p.p) GROUP BY item_id""", model=False)
def _(t):
    return text.located(t.read("documents").select("doc_id", "text"), t.read("benchmark").select("item_id", "text"))


@query("e_page_text", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style|sup)\b[^>]*>.*?</(script|style|sup)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""", model=False)
def _(t):
    return t.read("pages").select("page_id", F.md5(pages.page_text(F.col("html"))).alias("text_md5"))


@query("e_page_links", r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages""", model=False)
def _(t):
    return pages.links(t.read("pages").select("page_id", "html"))


@query("e_page_units")
def _(t):
    return pages.units_from_blocks(pages.blocks(t.read("pages").select("page_id", "html")))


@query("e_answer_ids", r"""SELECT DISTINCT conv_id, turn, 'a_' || substr(sha1('en|' || regexp_replace(regexp_replace(trim(coalesce("text", '')), '\s+', ' ', 'g'), '[?？！!。.]+$', '')), 1, 12) AS answer FROM conversations WHERE role = 'user'""", model=False)
def _(t):
    c = t.read("conversations").where("role = 'user'")
    return c.select("conv_id", "turn", codes.answer_id(F.lit("en"), F.col("text")).alias("answer")).distinct()


POINT_SQL = "WITH pt AS (SELECT vec_id AS id, label, CAST(vec_id // 10 AS BIGINT) AS unit, round(CAST(embedding[1] AS DOUBLE) * 95, 4) AS x, round(CAST(embedding[2] AS DOUBLE) * 95, 4) AS y FROM embeddings)"


def points(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.read("embeddings").select(F.col("vec_id").alias("id"), "label", F.floor(F.col("vec_id") / 10).alias("unit"), F.round(e[0].cast("double") * 95, 4).alias("x"), F.round(e[1].cast("double") * 95, 4).alias("y"))


@query("f_tiles", POINT_SQL + """, k AS (SELECT *, CAST(floor(x / 8) AS BIGINT) || '_' || CAST(floor(y / 8) AS BIGINT) AS grid_key FROM pt), per AS (SELECT grid_key, label, count(*) AS n FROM k GROUP BY ALL),
dom AS (SELECT grid_key, label AS dominant FROM per QUALIFY row_number() OVER (PARTITION BY grid_key ORDER BY n DESC, label) = 1)
SELECT grid_key, round(sum(x) / count(*), 6) AS x, round(sum(y) / count(*), 6) AS y, count(*) AS count, any_value(dominant) AS dominant, CAST(floor(sum(unit) / count(*) + 0.5) AS BIGINT) AS avg_unit, min(unit) AS min_unit, max(unit) AS max_unit FROM k JOIN dom USING (grid_key) GROUP BY grid_key""", model=False)
def _(t):
    return vectors.tiles(points(t))


@query("f_box", POINT_SQL + " SELECT * FROM pt WHERE x BETWEEN -5 AND 15 AND y BETWEEN -10 AND 10 ORDER BY id LIMIT 101", model=False)
def _(t):
    return vectors.box(points(t), (-5, 15), (-10, 10), 100)


@query("f_era", POINT_SQL + " SELECT label, count(*) AS count, min(unit) AS min_unit, max(unit) AS max_unit FROM pt WHERE unit BETWEEN 5 AND 30 GROUP BY label ORDER BY count DESC, label LIMIT 10", model=False)
def _(t):
    return vectors.era(points(t), 5, 30)


@query("f_unit_matrix", POINT_SQL + " SELECT unit, label, count(*) AS n FROM pt GROUP BY unit, label", model=False)
def _(t):
    return edges.counts_by(points(t), "unit", "label")


@query("f_drift", POINT_SQL + """, p AS (SELECT *, unit // 10 AS period FROM pt), g AS (SELECT label, period, count(*) AS count, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p GROUP BY label, period), tot AS (SELECT period, count(*) AS total FROM p GROUP BY period)
SELECT label, period, count, round(count / total, 4) AS share, round(x, 3) AS x, round(y, 3) AS y, round(coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / 190, 0), 4) AS shift FROM g JOIN tot USING (period) WINDOW w AS (PARTITION BY label ORDER BY period)""", model=False)
def _(t):
    return vectors.drift(points(t), F.floor(F.col("unit") / 10))


CENT_SQL = """WITH cell AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, round(avg(CAST(v AS DOUBLE)), 9) AS v FROM cell GROUP BY label, i),
cent AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY label), vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""


@query("f_centroids", CENT_SQL + " SELECT cent.label AS label, n AS size, round(list_sum(list_transform(c, lambda x: x * x)), 6) AS sq FROM cent JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)", model=False)
def _(t):
    c = vectors.centroids(t.read("embeddings"))
    return c.select("label", "size", F.round(vectors.dot("centroid", "centroid"), 6).alias("sq"))


@query("f_representatives", CENT_SQL + " SELECT * FROM (SELECT label, vec_id, round(list_cosine_similarity(e, c), 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(e, c), 6) DESC, vec_id) AS rank FROM vec JOIN cent USING (label)) WHERE rank <= 4", model=False)
def _(t):
    e = t.read("embeddings")
    return vectors.representatives(e, vectors.centroids(e))


@query("f_cluster_links", CENT_SQL + ", pr AS (SELECT a.label AS a, b.label AS b, round(0.5 * list_cosine_similarity(a.c, b.c) + 0.5 * list_dot_product(a.c, b.c), 4) AS similarity FROM cent a JOIN cent b ON a.label <> b.label), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM pr) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, similarity FROM r WHERE rank <= 3", model=False)
def _(t):
    return vectors.cluster_links(vectors.centroids(t.read("embeddings")))


@query("f_outliers", CENT_SQL + """, sim AS (SELECT vec_id, vec.label AS label, cent.label AS other, round(list_cosine_similarity(e, c), 9) AS s FROM vec, cent),
own AS (SELECT vec_id, label, s AS own, round(1 - s, 9) AS d FROM sim WHERE label = other), best AS (SELECT vec_id, max(struct_pack(s := s, m := -other)) AS b FROM sim WHERE label <> other GROUP BY vec_id),
mid AS (SELECT label, median(d) AS mid FROM own GROUP BY label), mad AS (SELECT own.label, median(abs(d - mid)) AS mad FROM own JOIN mid USING (label) GROUP BY own.label),
z AS (SELECT vec_id, own.label AS label, (d - mid) / CASE WHEN mad * 1.4826 > 0 THEN mad * 1.4826 ELSE 1e-6 END AS z, -b.m AS nearest, CAST(coalesce(b.s > own, false) AS INTEGER) AS misplaced FROM own JOIN mid USING (label) JOIN mad USING (label) LEFT JOIN best USING (vec_id))
SELECT vec_id, label, round(z, 3) AS score, nearest, misplaced, CAST(z > 2.5 OR misplaced = 1 AND z > 1.5 AS INTEGER) AS flag FROM z""", model=False)
def _(t):
    e = t.read("embeddings")
    return vectors.outliers(e, vectors.centroids(e))


@query("f_nearest", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM r) WHERE rank <= 10", model=False)
def _(t):
    e = t.read("embeddings")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"))


FLOW_SQL = EDGE_SQL + """, grp AS (SELECT src, lower(predicate) AS predicate, dst, CAST(sum(support_count) AS BIGINT) AS value FROM edge WHERE src <> dst GROUP BY ALL),
ts AS (SELECT src FROM grp GROUP BY src ORDER BY sum(value) DESC, src LIMIT 20), td AS (SELECT dst FROM grp GROUP BY dst ORDER BY sum(value) DESC, dst LIMIT 20),
flow AS (SELECT * FROM grp WHERE src IN (FROM ts) AND dst IN (FROM td) ORDER BY value DESC, src, predicate, dst LIMIT 40)"""


@query("g_flows", FLOW_SQL + " SELECT * FROM flow")
def _(t):
    return flows.flows(edges.edges(t.live))


@query("g_flow_nodes", FLOW_SQL + " SELECT kind, node, CAST(sum(value) AS BIGINT) AS value FROM (SELECT 'src' AS kind, src AS node, value FROM flow UNION ALL SELECT 'rel', predicate, value FROM flow UNION ALL SELECT 'dst', dst, value FROM flow) GROUP BY kind, node")
def _(t):
    return flows.flow_nodes(flows.flows(edges.edges(t.live)))


@query("g_ledger", " SELECT ch, count(*) AS claims, count(DISTINCT src) AS subjects, count(DISTINCT predicate) AS predicates FROM live GROUP BY ch")
def _(t):
    return flows.ledger(t.live)


@query("g_time_range", STATS_SQL + " SELECT greatest(1, min(first_chapter)) AS lo, greatest(max(first_chapter), greatest(1, min(first_chapter)) + 10) AS hi FROM stat")
def _(t):
    return flows.time_range(statistics(t), "first_chapter")


@query("g_search", STATS_SQL + " SELECT entity_id, name, claim_count FROM stat WHERE contains(lower(name), '00001') AND entity_type = 'Person' ORDER BY CASE WHEN name = '00001' THEN 0 WHEN starts_with(name, '00001') THEN 1 ELSE 2 END, claim_count DESC, entity_id LIMIT 20")
def _(t):
    return flows.search(statistics(t), "00001", "Person").select("entity_id", "name", "claim_count")


@query("g_sources", f", m AS (SELECT ch, count(DISTINCT claim_id) AS claim_count FROM live WHERE src = '{PERSON}' OR dst = '{PERSON}' GROUP BY ch) SELECT ch, n AS mentions, coalesce(claim_count, 0) AS claim_count FROM appear LEFT JOIN m USING (ch) WHERE entity_id = '{PERSON}' ORDER BY claim_count DESC, mentions DESC, ch LIMIT 20")
def _(t):
    return flows.sources(t.appearances, t.live, PERSON)


@query("g_timeline", f" SELECT DISTINCT claim_id, src, dst, predicate, ch FROM claim WHERE (src = '{PERSON}' OR dst = '{PERSON}') AND ch BETWEEN 10 AND 60 ORDER BY ch, claim_id LIMIT 500")
def _(t):
    return flows.timeline(t.claims, PERSON, 10, 60)


TASK_SQL = "WITH task AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'done' ELSE 'pending' END AS status, 10 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders)"


def tasks(t: Tables) -> DataFrame:
    o = t.read("orders")
    return o.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "O", "processing").when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), (10 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"))


@query("g_task_counts", TASK_SQL + " SELECT s.status, count(task.status) AS n FROM (VALUES ('pending'), ('processing'), ('done'), ('failed')) s(status) LEFT JOIN task USING (status) GROUP BY s.status", model=False)
def _(t):
    return flows.status_counts(tasks(t), ["pending", "processing", "done", "failed"])


@query("g_task_queue", TASK_SQL + " SELECT * FROM task ORDER BY CASE status WHEN 'processing' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, priority DESC, task_id LIMIT 30", model=False)
def _(t):
    return flows.task_queue(tasks(t))


@query("g_visible_edges", EDGE_SQL + " SELECT src, predicate, dst FROM edge WHERE predicate <> 'ORDERED' AND src IN (SELECT entity_id FROM ent WHERE entity_type <> 'Item') AND dst IN (SELECT entity_id FROM ent WHERE entity_type <> 'Item')")
def _(t):
    return flows.visible_edges(edges.edges(t.live), t.entities, ["Item"], ["ORDERED"]).select("src", "predicate", "dst")


@query("g_orphans", " SELECT entity_id FROM ent WHERE entity_id NOT IN (SELECT src FROM live UNION SELECT dst FROM live)")
def _(t):
    return flows.orphans(t.entities, t.live).select("entity_id")


@query("g_top_and_other", " , c AS (SELECT ch, count(*) AS n FROM claim GROUP BY ch), b AS (SELECT ch FROM c ORDER BY n DESC, ch LIMIT 8) SELECT CASE WHEN ch IN (FROM b) THEN CAST(ch AS VARCHAR) ELSE 'other' END AS ch, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def _(t):
    return flows.top_and_other(edges.counts_by(t.claims, "ch"), "ch", "n")


@query("h_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", model=False)
def _(t):
    return events.tumbling(events.with_time(t.read("events")))


@query("h_sliding", "WITH k AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * unnest(range(4)) AS start FROM events) SELECT start, event_type, count(*) AS n FROM k GROUP BY 1, 2", model=False)
def _(t):
    return events.sliding(events.with_time(t.read("events")))


@query("h_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS past, count(*) AS n FROM g GROUP BY user_id, k", model=False)
def _(t):
    return events.sessions(events.with_time(t.read("events")))


@query("h_over_limit", "SELECT * FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS used FROM events) WHERE used > 3", model=False)
def _(t):
    return events.over_limit(events.with_time(t.read("events")), 3, 86_400)


@query("h_task_states", """WITH RECURSIVE log AS (SELECT user_id, ['enqueue', 'claim', 'fail', 'done'][event_id % 4 + 1] AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
run AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, '' AS status, 0 AS tries, 0 AS priority FROM log
UNION ALL SELECT run.user_id, log.i, CASE WHEN a = 'enqueue' THEN CASE WHEN status IN ('', 'pending') THEN 'pending' ELSE status END WHEN a = 'claim' THEN 'processing' WHEN a = 'done' THEN 'done' WHEN tries >= 2 THEN 'failed' ELSE 'pending' END,
CASE WHEN a = 'fail' THEN tries + 1 ELSE tries END, CASE WHEN a = 'enqueue' AND status IN ('', 'pending') THEN 100 ELSE priority END FROM run JOIN log ON log.user_id IS NOT DISTINCT FROM run.user_id AND log.i = run.i + 1)
SELECT user_id AS task_id, status, tries, priority FROM run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""", model=False)
def _(t):
    e = t.read("events")
    log = e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, ["enqueue", "claim", "fail", "done"])), (F.col("event_id") % 4 + 1).cast("int")).alias("action"), F.lit(100).alias("priority"))
    return events.task_states(log)
