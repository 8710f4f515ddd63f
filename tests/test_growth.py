"""Steps that must grow with their input or their result, on small made-up rows."""

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F
from quillgraph.operators import board, contain, edges, entities, evidence, graph, text, vector_index
from quillgraph.plans import harness


def joins(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_meet_by_name(spark):
    names = ["old ring", "ring", "hot bolt", "bolt", "ri", "", None]
    rows = [(f"g{i % 2}", i, names[i % 7], i % 23 if i % 11 else None) for i in range(160)]
    events = spark.createDataFrame(rows, "graph_id STRING, event_id INT, name STRING, unit INT")
    found = entities.events_near(events)
    want = sorted(
        (a, b) for g, a, na, ua in rows for h, b, nb, ub in rows
        if g == h and a < b and None not in (na, nb, ua, ub) and abs(ua - ub) <= 5 and min(len(na), len(nb)) >= 3 and (na in nb or nb in na)
    )
    assert sorted(map(tuple, found.collect())) == want
    assert "nb#" in [line for line in joins(found).splitlines() if "Join" in line][0]  # not by graph and time alone


def test_numbered_names_meet_their_own_texts_only(spark):
    names = [(i, f"Customer#{i:09d}") for i in range(1500)]
    texts = [(i, f"What links Customer#{i:09d} with CHINA?") for i in range(1500)]
    n, h = spark.createDataFrame([*names, (-1, "CHINA")], "id INT, text STRING"), spark.createDataFrame(texts, "id INT, text STRING")
    left, right = contain._sides(n, h, ())
    assert contain._candidates(left.select("needle").distinct(), right.select("key", "hay").distinct(), 32, ()).count() == 3000
    assert {tuple(r) for r in contain.contained(n, h).collect()} == {(i, i) for i in range(1500)} | {(-1, i) for i in range(1500)}


def test_copies_of_texts_meet_once(spark):
    n = spark.createDataFrame([(i, "name of one") for i in range(30)] + [(99, "two")], "id INT, text STRING")
    h = spark.createDataFrame([(i, "who is name of one, two?") for i in range(40)], "id INT, text STRING")
    assert contain.texts_within(n, h).count() == 2
    assert contain.contained(n, h).count() == 31 * 40
    got = evidence.mentions(h, n).collect()
    assert {tuple(r) for r in got} == {(i, e, e + 1) for i in range(40) for e in range(4)}


def test_units_as_bit_sets(spark):
    places = [(e, u) for e, us in {1: (-35, -1, 0, 48), 2: (-1, 48, 5000, 5000), 3: (None, 7)}.items() for u in us]
    units = edges.entity_units(spark.createDataFrame(places, "entity_id INT, ch INT"))
    got = {r["entity_id"]: (r["first"], len(r["units"])) for r in units.where("entity_id < 3").collect()}
    assert got == {1: (-35, 4), 2: (-1, 3)}
    a, b = (units.selectExpr(f"entity_id AS e{x}", f"units AS u{x}") for x in "ab")
    both = a.crossJoin(b).select("ea", "eb", edges.shared_units("ua", "ub").alias("n"))
    assert {(r["ea"], r["eb"]): r["n"] for r in both.collect() if r["ea"] < r["eb"]} == {(1, 2): 2, (1, 3): 0, (2, 3): 0}


def test_hubs_read_the_graph_once(spark):
    g = spark.createDataFrame([(i, i + 1 + i % 3, 0.5) for i in range(40)], "a INT, b INT, weight DOUBLE")
    labels = spark.createDataFrame([(i, i // 9) for i in range(44)], "node INT, community INT")
    assert joins(graph._ends(g, labels)).count("weight#") > 0
    want: dict = {}
    for i in range(40):
        for x, y in ((i, i + 1 + i % 3), (i + 1 + i % 3, i)):
            want.setdefault(x, []).append(y // 9)
    got = {r["entity_id"]: (r["weighted_degree"], r["community_span"]) for r in graph.hubs(g, labels).collect()}
    assert got == {n: (0.5 * len(c), len(set(c))) for n, c in want.items()}


def test_search_reads_all_documents_and_vectors(spark, tmp_path):
    from quillgraph.plans import catalogue, more  # noqa: F401

    spark.createDataFrame([(i, "all rights reserved" if i in (5, 70, 71, 72) else "x") for i in range(80)], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "vec_id LONG, embedding ARRAY<FLOAT>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["l_search"](spark, str(tmp_path)).collect()]
    assert got[:4] == [(i, "words") for i in (5, 70, 71, 72)]  # three of them have no vector
    assert got[4:] == [(i, "meaning") for i in range(1, 21) if i != 5][:16]


def test_tags_count_names_once(spark):
    units = spark.createDataFrame([(1, "the cat, the dog; catalogue"), (2, None), (3, "New York the")], "doc_id LONG, text STRING")
    for names in ([("a", "the"), ("b", "cat"), ("c", "dog")], [("a", "the"), ("b", "cat"), ("c", "dog"), ("d", "New York")]):
        found = board.tags(text.name_counts(units, names), 2)
        assert joins(found).count("MapInArrow") == 1
        want = {1: (["a", "b"], 3), 3: (["d", "a"], 2) if len(names) > 3 else (["a"], 1)}
        got = {r["id"]: (r["tags"], r["found"]) for r in found.collect()}
        assert {k: (sorted(t), n) for k, (t, n) in got.items()} == {k: (sorted(t), n) for k, (t, n) in want.items()} and got[1] == want[1]


def test_components_send_no_labels_to_all_tasks(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 7], "a INT, b INT")
    plans = []
    kept, graph.stored = graph.stored, lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, label))[1]
    try:
        got = {r["node"]: r["component"] for r in graph.components(pairs).collect()}
    finally:
        graph.stored = kept
    assert got == {i: max(j for j in (1, 8, 15, 22, 29) if j <= i) for i in range(1, 31)}
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_first_of_each_row():
    rng = np.random.default_rng(5)
    s = np.round(rng.random((30, 200)), 2) + rng.random((30, 200)) * 3e-7  # many ties once rounded
    s[rng.random(s.shape) < 0.1] = -np.inf
    ids = rng.permutation(200)
    for k in (1, 10, 250):
        i, j, best = vector_index.firsts(s.copy(), ids, k)
        for row in range(30):
            want = sorted((-round(x, 6), n) for x, n in zip(s[row], ids, strict=True) if x > -np.inf)[:k]
            assert [(-b, n) for b, n in zip(best[i == row], ids[j[i == row]], strict=True)] == want


def test_coded_claims_say_what_claims_say(spark):
    t = harness.Tables(spark, SMALL)
    cols = ["claim_id", "src", "dst", "predicate", "ch", "confidence", "evidence"]
    got = harness.shown_claims(t.coded_claims).select(*cols, "live")
    want = t.claims.select(*cols, (F.col("status") != "rejected").alias("live"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert dict(t.coded_claims.dtypes)["src"] == "bigint"


def test_gather_reads_claims_with_their_edges(spark):
    """The picked claims come with the stored edges, so lines aren't read, shuffled and joined by edge again."""
    from quillgraph.plans import catalogue, composed  # noqa: F401

    assert not [f for f in catalogue.QUERIES["l_gather"](spark, SMALL).inputFiles() if "lineitem" in f or "orders" in f]


def test_cited_edges_have_the_first_claims_of_edges(spark):
    t = harness.Tables(spark, SMALL)
    live = t.coded_claims.where("live").withColumns(harness.claim_key())
    units = edges.entity_units(t.coded_places)
    found = edges.cited_edges(live, units, ["key", "line"], ["ch", harness.cited(F.struct("predicate", "key", "line"))])
    said = F.transform("firsts", lambda c: harness.cited(F.struct(F.col("predicate").alias("predicate"), c["key"].alias("key"), c["line"].alias("line"))))
    got = {(r["src"], r["predicate"], r["dst"]): (r["weight"], r["firsts"]) for r in harness.spelled(found.withColumn("firsts", said), "src", "dst").collect()}
    weights = {(r["src"], r["predicate"], r["dst"]): r["weight"] for r in harness.spelled(edges.edge_metrics(live, units), "src", "dst").collect()}
    want: dict = {}
    for r in t.live.select("src", "predicate", "dst", "ch", "claim_id").collect():
        want.setdefault((r["src"], r["predicate"], r["dst"]), []).append((r["ch"], r["claim_id"]))
    assert any(len(c) > 2 for c in want.values())
    assert got == {e: (weights[e], [i for _, i in sorted(c)[:2]]) for e, c in want.items()}


def test_communities_take_few_rounds_and_lose_none(spark):
    from quillgraph.plans import catalogue

    labels_of, tables = [], []
    kept, graph.stored = graph.stored, lambda df, label: (tables.append(label), kept(df, label))[1]
    try:
        _, g, labels = catalogue._community(harness.Tables(spark, SMALL))
        labels_of = labels.collect()
    finally:
        graph.stored = kept
    assert tables.count("louvain-moves") <= 22 and "louvain-names" not in tables
    weights, of, ends, inside = {}, {r["node"]: r["community"] for r in labels_of}, {}, 0.0
    for a, b, w in g.select("a", "b", "weight").collect():
        weights[a, b] = w
        inside += w * (of[a] == of[b])
        for x in (a, b):
            ends[of[x]] = ends.get(of[x], 0.0) + w
    m = sum(weights.values())
    assert inside / m - sum(d * d for d in ends.values()) / (4 * m * m) > 0.08


def test_recommendations_shuffle_edges_of_neighbours_only(spark):
    rows = [("a", "z"), ("z", "b"), ("b", "a2"), ("y", "a"), ("c", "y"), ("b", "y"), ("y", "z")] + [(f"x{i}", f"w{i}") for i in range(500)]
    tables = {}
    kept, graph.stored = graph.stored, lambda df, label: tables.setdefault(label, kept(df, label))
    try:
        got = [tuple(r) for r in graph.related(spark.createDataFrame(rows, "src STRING, dst STRING"), "a").collect()]
    finally:
        graph.stored = kept
    assert [(n, shared) for n, _, shared in got] == [("b", 2), ("c", 1)]
    assert tables["related-near"].count() == 7  # of z: a, b, y; of y: a, b, c, z


def test_sections_are_shuffled_by_book_only(spark):
    from quillgraph.sources import contents

    body = spark.createDataFrame([(b, i, f"## 1.{i // 2 + 1} part {i // 2 + 1}" if i % 2 == 0 else "text") for b in ("x", "y") for i in range(8)], "book STRING, at INT, line STRING")
    toc = spark.createDataFrame([(b, n, 1, n, f"part {n}") for b in ("x", "y") for n in (1, 2, 3, 4)], "book STRING, seq INT, chapter_no INT, section_no INT, title STRING")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contents.by_sections(body, toc)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["book"], r["seq"], r["at"]) for r in found.collect()) == [(b, n, 2 * n - 1) for b in ("x", "y") for n in (1, 2, 3, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = [line.split("hashpartitioning(")[1].split(")")[0].split(",")[:-1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and all(len(keys) == 1 and keys[0].startswith("book#") for keys in dealt)


def test_vectors_travel_as_they_are_stored(spark):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)], "vec_id LONG, embedding ARRAY<FLOAT>")
    index = vector_index.build(v, cells=4)
    assert dict(index.rows.dtypes)["v"] == "array<float>"
    m = vector_index.unit(v.select("embedding").toArrow().column(0))
    got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in vector_index.search(index, v, 3, exact=True).collect())
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -9)
    want = [(i, k + 1, int(j), s[i, j]) for i in range(60) for k, j in enumerate(sorted(range(60), key=lambda j: (-s[i, j], j))[:3])]
    assert [g[:3] for g in got] == [w[:3] for w in want]
