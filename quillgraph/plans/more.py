"""Further registered queries: shaping of names and numbers (i), resolution (j), clusters (k), notes and answers (l), views (m).

They join those of ``catalogue``; the same helper registers them.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import codes, shaping
from quillgraph.operators import clusters, contain, edges, entities, graph, notes, vectors
from quillgraph.plans.catalogue import EDGE_SQL, OTHER, PERSON, _community, metrics, query
from quillgraph.plans.harness import named, shown_claims, spelled
from quillgraph.plans.storage import stored
from quillgraph.sources import books

# --- i: shaping

NUMERALS = "I II III IV V VI VII VIII IX X XIV XIX XL XC CD MCMXCIV".split()


@query("i_roman", "SELECT DISTINCT n.numeral, n.value FROM (VALUES " + ", ".join(f"('{n}', {v})" for n, v in zip(NUMERALS, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 14, 19, 40, 90, 400, 1994], strict=True)) + ") n(numeral, value)", model=False)
def _(t):
    frame = t.spark.createDataFrame([(n,) for n in NUMERALS], "numeral STRING")
    return frame.select("numeral", shaping.roman_value(F.col("numeral")).alias("value"))


@query("i_names", """SELECT p_partkey, upper(substr(p_name, 1, 1)) AS family, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS squashed,
lower(regexp_replace('The ' || p_name || ' Hall', '^(?i:the)\\s+', '')) AS item_key, regexp_replace(lower(p_name || ' Hall'), '\\s+(hall|house|mansion|park|manor|lodge|place)$', '') AS place_key,
p_name = lower(p_name) OR length(p_name) < 2 AS generic FROM part""", model=False)
def _(t):
    n = F.col("p_name")
    return t.read("part").select(
        "p_partkey", shaping.family_key(n).alias("family"), F.trim(F.regexp_replace(n, r"\s+", " ")).alias("squashed"), shaping.english_key(F.concat(F.lit("The "), n, F.lit(" Hall")), F.lit("Item")).alias("item_key"),
        shaping.english_key(F.concat(n, F.lit(" Hall")), F.lit("Place")).alias("place_key"), shaping.generic_english(n).alias("generic"),
    )


@query("i_sizes", """SELECT o_orderkey, round(5 + 13 * sqrt(o_totalprice / max(o_totalprice) OVER ()), 4) AS size, round(0.5 + 2.2 * (o_totalprice / max(o_totalprice) OVER ()), 4) AS width,
round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) * 2 * 95.0 - 95.0, 4) AS x,
round(50.0 - (greatest(1993.0, least(1997.0, CAST(year(o_orderdate) AS DOUBLE))) - 1993.0) / 4.0 * 100.0, 4) AS height FROM orders""", model=False)
def _(t):
    o = t.read("orders")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    price = F.col("o_totalprice")
    return o.crossJoin(F.broadcast(ends)).select(
        "o_orderkey", shaping.bubble_size(price, F.col("hi")).alias("size"), shaping.edge_width(price / F.col("hi")).alias("width"), shaping.scaled(price, F.col("lo"), F.col("hi")).alias("x"),
        shaping.layer_height(F.year("o_orderdate"), 1993, 1997).alias("height"),
    )


@query("i_jitter", """WITH RECURSIVE roll AS (SELECT c_custkey, c_name AS s, 0 AS i, CAST(0 AS BIGINT) AS h FROM customer
UNION ALL SELECT c_custkey, s, i + 1, (h * 31 + ascii(substr(s, i + 1, 1))) % 100000 FROM roll WHERE i < length(s))
SELECT c_custkey, round(h % 1000 / 1000.0 - 0.5, 3) AS jitter FROM roll WHERE i = length(s)""", model=False)
def _(t):
    return t.read("customer").select("c_custkey", shaping.jitter(F.col("c_name")).alias("jitter"))


IMUL = "(({a})::HUGEINT * ({b})::HUGEINT) % 4294967296"
STEP1 = IMUL.format(a="xor(t, t >> 15)", b="t | 1")
STEP2 = IMUL.format(a="xor(r, r >> 7)", b="r | 61")


@query("i_random", f"""WITH a AS (SELECT c_custkey, CAST((c_custkey + 5494697439) % 4294967296 AS BIGINT) AS t FROM customer), b AS (SELECT c_custkey, CAST({STEP1} AS BIGINT) AS r FROM a),
c AS (SELECT c_custkey, xor(r, CAST((r + CAST({STEP2} AS BIGINT)) % 4294967296 AS BIGINT)) AS r FROM b) SELECT c_custkey, round(xor(r, r >> 14) / 4294967296, 9) AS u FROM c""", model=False)
def _(t):
    return t.read("customer").select("c_custkey", F.round(shaping.seeded_random(F.col("c_custkey"), F.lit(3)), 9).alias("u"))


@query("i_times", """SELECT o_orderkey, CAST(epoch_ms(o_orderdate) AS BIGINT) AS millis, lower(to_base(CAST(epoch_ms(o_orderdate) AS BIGINT), 36)) AS time_id,
CAST((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1992-01-01')) / 60000 AS BIGINT) AS minutes FROM orders""", model=False)
def _(t):
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return t.read("orders").select("o_orderkey", millis.alias("millis"), shaping.time_id(millis).alias("time_id"), ((millis - F.lit(694224000000)) / 60000).cast("long").alias("minutes"))


@query("i_chapters", """SELECT l_orderkey, l_linenumber, array_to_string(list_distinct_ordered, ',') AS chapters FROM (SELECT l_orderkey, l_linenumber,
list_filter(list_concat(range(l_linenumber, l_linenumber + 3), [1]), lambda x, i: list_position(list_concat(range(l_linenumber, l_linenumber + 3), [1]), x) = i) AS list_distinct_ordered FROM lineitem)""", model=False)
def _(t):
    n = F.col("l_linenumber")
    spec = F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(",1"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(shaping.chapter_list(spec), lambda x: x.cast("string")), ",").alias("chapters"))


@query("i_props", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, 'k=' || coalesce(json_extract_string(props, '$.k'), '') AS shown FROM events""", model=False)
def _(t):
    p = shaping.nested_or(F.col("props"), "k INT", F.struct(F.lit(None).cast("int").alias("k")))
    return t.read("events").select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), F.concat(F.lit("k="), F.coalesce(p["k"].cast("string"), F.lit(""))).alias("shown"))


@query("i_fact_lines", " SELECT claim_id, '[1] ' || src || ' ' || predicate || ' ' || dst || ' (unit ' || ch || '): ' || evidence AS line FROM live WHERE predicate = 'KILLED'")
def _(t):
    k = t.live.where("predicate = 'KILLED'")
    return k.select("claim_id", shaping.fact_line(F.lit(1), F.col("src"), F.col("predicate"), F.col("dst"), F.col("ch"), F.col("evidence")).alias("line"))


@query("i_headings", """WITH h AS (SELECT page_id, '## ' || coalesce(url, '') || ' ..... ' || CAST(page_id % 900 AS VARCHAR) AS raw, coalesce(url, '') AS u FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[#*]', '', 'g'), '[\\s.…·]{2,}\\d{1,3}\\s*$', ''), '\\s+\\d{1,3}\\s*$', ''), '\\s+', ' ', 'g')) AS heading FROM h""", model=False)
def _(t):
    raw = F.concat(F.lit("## "), F.coalesce("url", F.lit("")), F.lit(" ..... "), (F.col("page_id") % 900).cast("string"))
    return t.read("pages").select("page_id", shaping.clean_heading(raw).alias("heading"))


@query("i_type_map", " SELECT '{' || string_agg('\"' || entity_type || '\":' || n, ',' ORDER BY entity_type) || '}' AS counts FROM (SELECT entity_type, count(*) AS n FROM ent GROUP BY entity_type)")
def _(t):
    counted = edges.counts_by(t.entities, "entity_type")
    return counted.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n"))))).alias("counts"))


@query("i_clean_claims", """ SELECT claim_id, greatest(0.0, least(1.0, coalesce(nullif(confidence - 0.9, 0.0), 0.8))) AS confidence FROM claim WHERE predicate IN ('ORDERED', 'KILLED') AND src <> dst AND upper(src) <> upper(dst)""")
def _(t):
    c = t.claims
    ok = shaping.kept_claim(F.upper("src"), F.col("predicate"), F.upper("dst"), ["ORDERED", "KILLED"])
    return c.where(ok).select("claim_id", shaping.clamped_confidence(F.col("confidence") - 0.9).alias("confidence"))


# --- j: resolution


def mentions(t):
    """Parts as mentions: the brand is the graph, the name is said with and without an article."""
    p = t.read("part")
    n = F.col("p_name")
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("The "), F.initcap(n))).otherwise(F.initcap(n))
    return p.select(F.col("p_brand").alias("graph_id"), F.col("p_size").alias("chapter"), F.lit(0).alias("win"), F.col("p_partkey").cast("int").alias("position"), said.alias("name"), F.lit("Item").alias("entity_type"), F.array(F.col("p_name")).alias("aliases"))


@query("j_resolved", """WITH m AS (SELECT p_brand AS graph_id, p_size AS chapter, p_partkey AS position, CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, p_name AS k FROM part),
f AS (SELECT *, first_value(name) OVER (PARTITION BY graph_id, lower(k) ORDER BY chapter, position) AS canonical FROM m)
SELECT graph_id, CAST(position AS INTEGER) AS position, name, canonical, 'e_' || substr(sha1(graph_id || ':Item:' || canonical), 1, 12) AS entity_id FROM f""", model=False)
def _(t):
    return entities.resolve(mentions(t)).select("graph_id", "position", "name", "canonical", "entity_id")


@query("j_aliases", """WITH RECURSIVE c AS (SELECT p_brand AS g, p_name AS n, p_type AS a, min(struct_pack(ch := p_size, pos := p_partkey)) AS o FROM part GROUP BY ALL),
k AS (SELECT g, o, 1 AS t, lower(n) AS key FROM c UNION ALL SELECT g, o, 2, lower(a) FROM c), f AS (SELECT g, key, min(o) AS fo FROM k GROUP BY ALL),
p AS (SELECT g, o, arg_min(fo, t) AS po FROM k JOIN f USING (g, key) WHERE fo < o GROUP BY g, o),
up AS (SELECT g, o, o AS r FROM c UNION ALL SELECT up.g, up.o, p.po FROM up JOIN p ON p.g = up.g AND p.o = up.r), top AS (SELECT g, o, min(r) AS r FROM up GROUP BY g, o)
SELECT p_brand AS graph_id, CAST(p_partkey AS INTEGER) AS position, root.n AS canonical, 'e_' || substr(sha1(p_brand || ':Item:' || root.n), 1, 12) AS entity_id
FROM part JOIN c ON c.g = p_brand AND c.n = p_name AND c.a = p_type JOIN top ON top.g = c.g AND top.o = c.o JOIN c root ON root.g = top.g AND root.o = top.r""", model=False)
def _(t):
    """Parts of a brand that share a type lead to one another through their aliases: long chains, one graph over all tasks."""
    p = t.read("part")
    said = p.select(F.col("p_brand").alias("graph_id"), F.col("p_size").alias("chapter"), F.lit(0).alias("win"), F.col("p_partkey").cast("int").alias("position"), F.col("p_name").alias("name"), F.lit("Item").alias("entity_type"), F.array("p_type").alias("aliases"))
    return entities.resolve(said).select("graph_id", "position", "canonical", "entity_id")


@query("j_quoted", "WITH q AS (SELECT item_id, lower(substr(\"text\", 1, 24)) AS s FROM benchmark) SELECT item_id, doc_id FROM q JOIN documents ON contains(lower(\"text\"), s) WHERE s <> ''", model=False)
def _(t):
    """Beginnings of benchmark items, wherever they stand in a document."""
    start = t.read("benchmark").select(F.col("item_id").alias("id"), F.lower(F.substring("text", 1, 24)).alias("text"))
    found = contain.contained(start, t.read("documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), gram=12)
    return found.select(F.col("needle_id").alias("item_id"), F.col("hay_id").alias("doc_id"))


@query("j_components", """WITH m AS (SELECT DISTINCT p_brand AS graph_id, CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, lower(p_name) AS k FROM part)
SELECT graph_id, name, min(name) OVER (PARTITION BY graph_id, k) AS canonical FROM m""", model=False)
def _(t):
    return entities.resolve_by_components(mentions(t)).select("graph_id", "name", "canonical")


@query("j_events", """WITH e AS (SELECT p_brand AS g, p_partkey AS id, p_name AS name, p_size AS unit FROM part) SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND abs(a.unit - b.unit) <= 5
AND least(length(a.name), length(b.name)) >= 3 AND (contains(a.name, b.name) OR contains(b.name, a.name))""", model=False)
def _(t):
    return entities.events_near(t.read("part").select(F.col("p_brand").alias("graph_id"), F.col("p_partkey").alias("event_id"), F.col("p_name").alias("name"), F.col("p_size").alias("unit")))


# --- k: clusters

UNIT_SQL = "WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings)"


@query("k_silhouette", UNIT_SQL + """, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, 1 - list_dot_product(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id), m AS (SELECT vec_id, own, other, avg(d) AS d FROM d GROUP BY ALL),
s AS (SELECT v.vec_id, (SELECT d FROM m WHERE m.vec_id = v.vec_id AND other = v.label) AS a, (SELECT min(d) FROM m WHERE m.vec_id = v.vec_id AND other <> v.label) AS b FROM v)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""", model=False)
def _(t):
    return clusters.silhouette(t.read("embeddings"))


@query("k_density", UNIT_SQL + """, s AS (SELECT a.vec_id AS id, round(list_dot_product(a.e, b.e), 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 6) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT id, round(sum(s) * 1e6) / 1e7 AS density FROM s WHERE r <= 10 GROUP BY id""", model=False)
def _(t):
    v = t.read("embeddings")
    return clusters.density(v, v)


@query("k_clusters")
def _(t):
    return clusters.kmeans(clusters.reduced(t.read("embeddings").select("vec_id", "embedding"), 16), 8).select("vec_id", "cluster")


@query("k_chosen")
def _(t):
    v = stored(clusters.reduced(t.read("embeddings").select("vec_id", "embedding"), 16), "reduced")
    k, found = clusters.choose_k(v, clusters.k_range(v.count()))
    return t.spark.createDataFrame([(n, s, n == k) for n, s in found.items()], "k INT, silhouette DOUBLE, chosen BOOLEAN")


@query("k_sub_clusters")
def _(t):
    v = stored(clusters.kmeans(clusters.reduced(t.read("embeddings").select("vec_id", "embedding"), 16), 2), "clusters")
    return clusters.sub_clusters(v).select("vec_id", "cluster", "sub_cluster")


@query("k_plane")
def _(t):
    return clusters.plane(t.read("embeddings").select("vec_id", "embedding")).select("vec_id", "x", "y")


@query("k_coverage", "SELECT count(*) AS total, count(label) AS clustered, count(DISTINCT label) AS clusters FROM embeddings", model=False)
def _(t):
    return t.read("embeddings").agg(F.count("*").alias("total"), F.count("label").alias("clustered"), F.count_distinct("label").alias("clusters"))


@query("k_board_sizes", "SELECT b.bucket, count(d.doc_id) AS n FROM (VALUES (0, 399, '0-399'), (400, 549, '400-549'), (550, 699, '550-699'), (700, 899, '700-899'), (900, 1000000000, '900+')) b(lo, hi, bucket) LEFT JOIN documents d ON greatest(0, d.n_chars) BETWEEN lo AND hi GROUP BY b.bucket", model=False)
def _(t):
    return clusters.bucket_counts(t.read("documents").where("n_chars IS NOT NULL"), "n_chars", [0, 400, 550, 700, 900])


@query("k_board_top", "SELECT source, lang, n, rank FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rank FROM documents GROUP BY source, lang) WHERE rank <= 2", model=False)
def _(t):
    return clusters.top_counts(t.read("documents"), "source", "lang", 2)


# --- l: notes and answers


SEARCH_SQL = """WITH d AS (SELECT doc_id AS id, "text", embedding AS e FROM documents JOIN embeddings ON vec_id = doc_id), lex AS (SELECT id, 0 AS kind, CAST(id AS DOUBLE) AS ord FROM d WHERE contains(coalesce("text", ''), '{words}')),
sem AS (SELECT d.id, 1 AS kind, -round(list_cosine_similarity(CAST(d.e AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS ord FROM d, d q WHERE q.id = 0 AND d.id <> 0 ORDER BY ord, d.id LIMIT 20),
every AS (SELECT * FROM lex UNION ALL SELECT * FROM sem WHERE id NOT IN (SELECT id FROM lex) AND (SELECT count(*) FROM lex) < 3) SELECT id, CASE kind WHEN 0 THEN 'words' ELSE 'meaning' END AS found_by FROM every ORDER BY kind, ord, id LIMIT 20"""


def searched(t, words: str):
    """Documents that have a vector: those with the words and, if these are fewer than three, those near document 0."""
    d = t.read("documents").join(t.read("embeddings"), F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("vec_id"), "text", "embedding")
    lexical = d.where(F.contains(F.coalesce("text", F.lit("")), F.lit(words))).select(F.col("vec_id").alias("id"))
    semantic = vectors.nearest(d, d.where("vec_id = 0"), 20).select("id", "similarity")
    return notes.hybrid(lexical, semantic, 20)


@query("l_search", """WITH lex AS (SELECT doc_id AS id, 0 AS kind, CAST(doc_id AS DOUBLE) AS ord FROM documents WHERE contains(coalesce("text", ''), 'rights reserved')),
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), sem AS (SELECT vec_id AS id, 1 AS kind, -round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS ord FROM embeddings, q WHERE vec_id <> 0 ORDER BY ord, id LIMIT 20),
every AS (SELECT * FROM lex UNION ALL SELECT * FROM sem WHERE id NOT IN (SELECT id FROM lex)) SELECT id, CASE kind WHEN 0 THEN 'words' ELSE 'meaning' END AS found_by FROM every ORDER BY kind, ord, id LIMIT 20""", model=False)
def _(t):
    """All documents by words and all vectors by meaning, whether or not an id has both."""
    lexical = t.read("documents").where(F.contains(F.coalesce("text", F.lit("")), F.lit("rights reserved"))).select(F.col("doc_id").alias("id"))
    e = t.read("embeddings")
    return notes.hybrid(lexical, vectors.nearest(e, e.where("vec_id = 0"), 20).select("id", "similarity"), 20, few=None)


@query("l_search_rare", SEARCH_SQL.format(words="no document says this"), model=False)
def _(t):
    return searched(t, "no document says this")


@query("l_pair_facts", f" SELECT claim_id FROM live WHERE (src = '{PERSON}' AND dst = 'n:' || (SELECT c_nationkey FROM customer WHERE c_custkey = 7)) OR (dst = '{PERSON}' AND src = 'n:' || (SELECT c_nationkey FROM customer WHERE c_custkey = 7)) ORDER BY claim_id LIMIT 8")
def _(t):
    nation = t.read("customer").where("c_custkey = 7").select(F.concat(F.lit("n:"), "c_nationkey").alias("other"))
    return notes.pair_facts(t.live, t.spark.createDataFrame([(PERSON,)], "one STRING").crossJoin(nation))


@query("l_missing_notes", """ , n AS (SELECT entity_id, count(*) AS claims FROM (SELECT src AS entity_id FROM live UNION ALL SELECT dst FROM live) GROUP BY entity_id)
SELECT n.entity_id, n.claims FROM n JOIN ent USING (entity_id) WHERE entity_type = 'Person' AND claims >= 2 AND CAST(substr(entity_id, 3) AS BIGINT) % 3 <> 0 AND NOT (CAST(substr(entity_id, 3) AS BIGINT) % 3 = 1 AND claims <= 60)""")
def _(t):
    people = t.entities.where("entity_type = 'Person'").select("entity_id", F.substring("entity_id", 3, 20).cast("long").alias("no"))
    have = people.where("no % 3 = 0").select("entity_id")
    skips = people.where("no % 3 = 1").select("entity_id", F.lit("too_few").alias("reason"), F.lit(60).cast("long").alias("claims"), F.lit(None).cast("timestamp").alias("at"), F.lit(1).alias("tries"))
    return notes.missing(edges.claim_counts(t.live).join(people.select("entity_id"), "entity_id"), have, skips, F.lit("2026-01-01").cast("timestamp"))


@query("l_answers", """WITH a AS (SELECT conv_id, turn, "text" AS question, row_number() OVER (PARTITION BY 'a_' || substr(sha1('en|' || regexp_replace(regexp_replace(trim(coalesce("text", '')), '\\s+', ' ', 'g'), '[?？！!。.]+$', '')), 1, 12) ORDER BY conv_id DESC, turn DESC) AS r,
'a_' || substr(sha1('en|' || regexp_replace(regexp_replace(trim(coalesce("text", '')), '\\s+', ' ', 'g'), '[?？！!。.]+$', '')), 1, 12) AS id FROM conversations WHERE role = 'user') SELECT id, conv_id, turn FROM a WHERE r = 1 ORDER BY conv_id DESC, turn DESC, id LIMIT 200""", model=False)
def _(t):
    asked = t.read("conversations").where("role = 'user'").select(codes.answer_id(F.lit("en"), F.col("text")).alias("id"), "conv_id", "turn")
    return notes.latest_answers(asked, ["conv_id", "turn"], 200)


@query("l_mentioned", f""", s AS (SELECT 'Where did ' || (SELECT name FROM ent WHERE entity_id = '{OTHER}') || ' meet ' || (SELECT name FROM ent WHERE entity_id = '{PERSON}') || '?' AS question)
SELECT entity_id, CAST(strpos(question, name) - 1 AS INTEGER) AS place FROM ent, s WHERE entity_type = 'Person' AND strpos(question, name) > 0 ORDER BY 2, 1 LIMIT 4""")
def _(t):
    people = t.entities.where("entity_type = 'Person'")
    names = {r["entity_id"]: r["name"] for r in people.where(F.col("entity_id").isin(PERSON, OTHER)).collect()}
    return notes.mentioned(people, f"Where did {names.get(OTHER)} meet {names.get(PERSON)}?")


@query("l_material", f" SELECT CAST(row_number() OVER (ORDER BY ch, claim_id) AS INTEGER) AS n, claim_id, src || ' ' || predicate || ' ' || dst AS relation, ch FROM live WHERE src = '{PERSON}' OR dst = '{PERSON}' ORDER BY n LIMIT 40")
def _(t):
    return notes.material(t.live.where((F.col("src") == PERSON) | (F.col("dst") == PERSON)), 40)


# --- m: views


@query("m_chapter_cast", " SELECT ch, string_agg(entity_id, ',' ORDER BY n DESC, entity_id) AS cast_ids FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY n DESC, entity_id) AS r FROM appear JOIN ent USING (entity_id) WHERE entity_type = 'Person') WHERE r <= 12 GROUP BY ch")
def _(t):
    people = t.appearances.join(t.entities.where("entity_type = 'Person'").select("entity_id"), "entity_id", "left_semi")
    ranked = people.withColumn("r", F.row_number().over(Window.partitionBy("ch").orderBy(F.desc("n"), "entity_id"))).where("r <= 12")
    return ranked.groupBy("ch").agg(F.array_join(F.sort_array(F.collect_list(F.struct("r", "entity_id")))["entity_id"], ",").alias("cast_ids"))


@query("m_lanes", """ , k AS (SELECT ent.entity_type || '>' || predicate AS lane, count(*) AS n FROM live JOIN ent ON src = entity_id GROUP BY 1), l AS (SELECT * FROM k ORDER BY n DESC, lane LIMIT 3)
SELECT lane, claim_id, ch FROM (SELECT l.lane, claim_id, ch, row_number() OVER (PARTITION BY l.lane ORDER BY ch DESC, claim_id) AS r FROM live JOIN ent ON src = entity_id JOIN l ON l.lane = ent.entity_type || '>' || predicate) WHERE r <= 50""")
def _(t):
    kinds = t.live.join(t.entities.select(F.col("entity_id").alias("src"), "entity_type"), "src").select("claim_id", "ch", F.concat("entity_type", F.lit(">"), "predicate").alias("lane"))
    return notes.lanes(kinds, 3, 50)


@query("m_time_range", """ SELECT CAST(floor((lo - pad) / 5) * 5 AS BIGINT) AS first_year, CAST(ceil((hi + pad) / 5) * 5 AS BIGINT) AS last_year FROM (SELECT lo, hi, greatest(hi - lo, 60) * 0.08 AS pad FROM (SELECT min(ch) AS lo, greatest(max(ch), min(ch) + 60) AS hi FROM live))""")
def _(t):
    return notes.time_range(t.live, "ch")


@query("m_source_summary", "SELECT source, count(*) AS files, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS size, count(*) FILTER (WHERE coalesce(\"text\", '') = '') AS pending, count(DISTINCT lang) AS categories FROM documents GROUP BY source", model=False)
def _(t):
    empty = F.coalesce("text", F.lit("")) == ""
    return t.read("documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("size"), F.count_if(empty).alias("pending"), F.count_distinct("lang").alias("categories"))


@query("m_legacy_totals", " SELECT (SELECT count(*) FROM ent WHERE entity_type = 'Person') AS persons, (SELECT count(*) FROM claim WHERE predicate <> 'NATIVE_OF') AS relations, (SELECT count(*) FROM claim WHERE predicate = 'KILLED') AS events, (SELECT count(DISTINCT predicate) FROM claim) AS topics")
def _(t):
    c = t.claims.agg(F.count_if(F.col("predicate") != "NATIVE_OF").alias("relations"), F.count_if(F.col("predicate") == "KILLED").alias("events"), F.count_distinct("predicate").alias("topics"))
    return t.entities.agg(F.count_if(F.col("entity_type") == "Person").alias("persons")).crossJoin(c)


@query("m_titles", " SELECT claim_id, coalesce(l.l_returnflag, 'none') AS title FROM live LEFT JOIN (SELECT 'k:' || l_orderkey || ':' || l_linenumber AS id, l_returnflag FROM lineitem WHERE l_linenumber < 4) l ON id = claim_id WHERE predicate = 'KILLED'")
def _(t):
    titles = t.read("lineitem").where("l_linenumber < 4").select(F.concat_ws(":", F.lit("k"), "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_returnflag").alias("title"))
    return t.live.where("predicate = 'KILLED'").select("claim_id").join(titles, "claim_id", "left").withColumn("title", F.coalesce("title", F.lit("none")))


@query("m_hint_places", " SELECT src AS entity_id, string_agg(dst, ',' ORDER BY dst) AS places FROM (SELECT DISTINCT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM (SELECT DISTINCT src, dst FROM live WHERE predicate = 'KILLED')) WHERE r <= 3 GROUP BY src")
def _(t):
    near = t.live.where("predicate = 'KILLED'").groupBy("src").agg(F.slice(F.array_sort(F.collect_set("dst")), 1, 3).alias("p"))
    return near.select(F.col("src").alias("entity_id"), F.array_join("p", ",").alias("places"))


@query("m_confident_edges", EDGE_SQL + f" SELECT src, predicate, dst, weight FROM metric WHERE confidence >= 0.9 AND predicate IN ('ORDERED', 'RETURNED') AND src IN ('{PERSON}', '{OTHER}')")
def _(t):
    ids = t.entities.where(F.col("entity_id").isin(PERSON, OTHER) | F.col("entity_id").startswith("p:"))
    return graph.edges_among(metrics(t), ids, 0.9, ["ORDERED", "RETURNED"]).select("src", "predicate", "dst", "weight")


@query("m_neighbourhood", f" SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM live WHERE (src = '{PERSON}' OR dst = '{PERSON}') AND src <> dst")
def _(t):
    return notes.neighbourhood(t.live, PERSON)


@query("m_keyword_sets", """WITH w AS (SELECT DISTINCT source, lang FROM documents WHERE source IN ('src0', 'src1')), a AS (SELECT lang FROM w WHERE source = 'src0'), b AS (SELECT lang FROM w WHERE source = 'src1')
SELECT (SELECT string_agg(lang, ',' ORDER BY lang) FROM a WHERE lang IN (SELECT lang FROM b)) AS shared, coalesce((SELECT string_agg(lang, ',' ORDER BY lang) FROM b WHERE lang NOT IN (SELECT lang FROM a)), '') AS fresh,
coalesce((SELECT string_agg(lang, ',' ORDER BY lang) FROM a WHERE lang NOT IN (SELECT lang FROM b)), '') AS gone,
round((SELECT count(*) FROM a WHERE lang IN (SELECT lang FROM b)) / (SELECT count(*) FROM (SELECT lang FROM a UNION SELECT lang FROM b)), 4) AS jaccard""", model=False)
def _(t):
    d = t.read("documents").where(F.col("lang").isNotNull())
    sets = d.agg(F.collect_set(F.when(F.col("source") == "src0", F.col("lang"))).alias("old"), F.collect_set(F.when(F.col("source") == "src1", F.col("lang"))).alias("new"))
    shared, fresh, gone, jaccard = notes.set_change(F.col("old"), F.col("new"))
    return sets.select(*(F.array_join(F.array_sort(c), ",").alias(n) for c, n in ((shared, "shared"), (fresh, "fresh"), (gone, "gone"))), F.round(jaccard, 4).alias("jaccard"))


@query("m_pass_diff", " SELECT 'first' AS only_in, count(*) AS n FROM (SELECT src, predicate, dst FROM claim WHERE ch <= 30 EXCEPT SELECT src, predicate, dst FROM claim WHERE ch > 20) UNION ALL SELECT 'second', count(*) FROM (SELECT src, predicate, dst FROM claim WHERE ch > 20 EXCEPT SELECT src, predicate, dst FROM claim WHERE ch <= 30)")
def _(t):
    a, b = (t.claims.where(c).select("src", "predicate", "dst") for c in ("ch <= 30", "ch > 20"))
    return notes.only_in(a, b)


@query("m_stale_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", model=False)
def _(t):
    return t.read("documents").select("doc_id").join(t.read("labels").select("doc_id"), "doc_id", "left_anti")


@query("m_file_order", """SELECT page_id, CAST(row_number() OVER (ORDER BY split_part(url, '/', 4), lpad(regexp_extract(url, '(\\d+)', 1), 8, '0'), url, page_id) AS INTEGER) AS no FROM pages WHERE url IS NOT NULL QUALIFY no <= 100""", model=False)
def _(t):
    p = t.read("pages").where("url IS NOT NULL").select("page_id", "url")
    keys = [F.split_part("url", F.lit("/"), F.lit(4)), F.lpad(F.regexp_extract("url", r"(\d+)", 1), 8, "0"), F.col("url"), F.col("page_id")]
    top = p.withColumns({f"k{i}": k for i, k in enumerate(keys)}).orderBy("k0", "k1", "k2", "k3").limit(100)
    return top.select("page_id", F.row_number().over(Window.orderBy("k0", "k1", "k2", "k3")).alias("no"))


@query("m_neighbours_in_row", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", model=False)
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.read("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return rows.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("m_up_to", " SELECT src, predicate, dst, count(*) AS n FROM live WHERE ch <= 24 GROUP BY src, predicate, dst")
def _(t):
    return t.live.where("ch <= 24").groupBy("src", "predicate", "dst").agg(F.count("*").alias("n"))


@query("m_frontier", f""" , e AS (SELECT src AS x, dst AS y FROM live WHERE predicate = 'KILLED' UNION SELECT dst, src FROM live WHERE predicate = 'KILLED'), seed AS (SELECT min(src) AS s FROM live WHERE predicate = 'KILLED'),
h1 AS (SELECT DISTINCT y AS n FROM e, seed WHERE x = s AND y <> s), h2 AS (SELECT DISTINCT y AS n FROM e JOIN h1 ON x = h1.n WHERE y NOT IN (SELECT n FROM h1) AND y <> (SELECT s FROM seed))
SELECT s AS entity_id, 0 AS depth FROM seed UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2""")
def _(t):
    k = t.live.where("predicate = 'KILLED'")
    return notes.frontier(k.select("src", "dst"), k.agg(F.min("src").alias("entity_id")), depth=2)


@query("m_page_numbers", """WITH p AS (SELECT page_id, page_id // 20 AS volume, page_id % 20 + 1 AS image_no, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 900 ELSE page_id % 20 - 1 END AS printed FROM pages),
o AS (SELECT a.page_id, a.volume, a.image_no, a.printed, list_sort(list(b.image_no - b.printed) FILTER (WHERE b.printed IS NOT NULL)) AS near FROM p a JOIN p b ON a.volume = b.volume AND abs(a.image_no - b.image_no) <= 4 GROUP BY ALL)
SELECT page_id, CAST(CASE WHEN near IS NULL OR len(near) = 0 THEN coalesce(printed, -1) WHEN image_no - near[len(near) // 2 + 1] >= 1 THEN image_no - near[len(near) // 2 + 1] ELSE coalesce(printed, -1) END AS INTEGER) AS printed FROM o""", model=False)
def _(t):
    n = F.col("page_id")
    printed = F.when(n % 7 == 0, None).when(n % 11 == 0, 900).otherwise(n % 20 - 1).cast("int")
    pages = t.read("pages").select("page_id", F.floor(n / 20).alias("volume"), (n % 20 + 1).cast("int").alias("image_no"), printed.alias("printed"))
    return books.repaired_page_numbers(pages).select("page_id", F.coalesce("printed", F.lit(-1)).alias("printed"))


@query("m_body_slice", """WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'x *** START OF THE BOOK ***' || chr(10) || coalesce(html, '') || '<p> *** END OF THE BOOK ***' ELSE coalesce(html, '') END AS h, coalesce(html, '') AS raw FROM pages)
SELECT page_id, md5(raw) AS body FROM p""", model=False)
def _(t):
    raw = F.coalesce("html", F.lit(""))
    h = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x *** START OF THE BOOK ***\n"), raw, F.lit("<p> *** END OF THE BOOK ***"))).otherwise(raw)
    return t.read("pages").select("page_id", F.md5(books.body_between(h, r"\*\*\* START OF", r"\*\*\* END OF")).alias("body"))


@query("m_margins", """WITH l AS (SELECT doc_id, unnest(string_split("text", chr(10))) AS line, generate_subscripts(string_split("text", chr(10)), 1) AS i, len(string_split("text", chr(10))) AS n, source FROM documents WHERE "text" IS NOT NULL),
z AS (SELECT *, (i = 1 OR i = n) AS zone, regexp_replace(lower(line), '\\d+', '#', 'g') AS k FROM l), c AS (SELECT source, k, count(DISTINCT doc_id) AS pages FROM z WHERE zone GROUP BY source, k), t AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source)
SELECT z.source, count(*) AS kept FROM z LEFT JOIN c ON z.zone AND c.source = z.source AND c.k = z.k JOIN t ON t.source = z.source WHERE NOT z.zone OR t.pages < 3 OR c.pages < greatest(3, ceil(t.pages * 0.3)) GROUP BY z.source""", model=False)
def _(t):
    d = t.read("documents").where("text IS NOT NULL").select("source", "doc_id", F.split("text", "\n").alias("lines"))
    lines = d.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.posexplode("lines").alias("i", "line"), F.size("lines").alias("n"))
    zone = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    return books.without_margins(lines.withColumn("zone", zone)).groupBy(F.col("book").alias("source")).agg(F.count("*").alias("kept"))


@query("m_paragraphs_of_ocr", """WITH l AS (SELECT doc_id, unnest(string_split("text", chr(10))) AS x FROM documents WHERE "text" IS NOT NULL), s AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(x), '^#{1,6}\\s*', ''), '^\\*\\*(.+)\\*\\*$', '\\1')), '[ \\t\\xa0]{2,}', ' ', 'g')) AS x, regexp_replace(regexp_replace(trim(x), '^#{1,6}\\s*', ''), '^\\*\\*(.+)\\*\\*$', '\\1') AS y FROM l)
SELECT doc_id, count(*) AS paragraphs FROM s WHERE y <> '' AND NOT regexp_full_match(y, '-{3,}') AND NOT regexp_full_match(y, '\\|?[\\s:|-]+\\|?') AND NOT regexp_full_match(y, '[（(]空白[）)]') GROUP BY doc_id""", model=False)
def _(t):
    d = t.read("documents").where("text IS NOT NULL")
    return d.select("doc_id", F.explode(books.ocr_lines(F.col("text"))).alias("line")).groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query("m_bilingual")
def _(t):
    return books.bilingual(t.read("pages").select("page_id", "html"))


@query("b_community_profiles")
def _(t):
    _, g, labels = _community(t)
    return graph.community_profiles(g, spelled(labels, "community"), t.coded_claims.where("live").drop("live", "priority"), edges.weighted_degree(g), shown=shown_claims, named=named)
