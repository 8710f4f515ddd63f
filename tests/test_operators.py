"""Small hand-made tables whose results follow from the definitions."""

import math

import pytest
from pyspark.sql import functions as F
from quillgraph.functions import codes
from quillgraph.operators import edges, flows, graph, review, rules, text
from quillgraph.sources import pages
from quillgraph.streaming import events

CLAIM = "claim_id STRING, src STRING, predicate STRING, dst STRING, ch INT, confidence DOUBLE, status STRING, evidence STRING"


def claims(spark, rows):
    return spark.createDataFrame([(f"c{i:02}", s, p, o, ch, conf, "auto_verified", ev) for i, (s, p, o, ch, conf, ev) in enumerate(rows)], CLAIM)


def simple(spark, rows):
    return claims(spark, [(s, p, o, ch, 0.9, f"{s} {p} {o}") for s, p, o, ch in rows])


def entities(spark, rows):
    return spark.createDataFrame(rows, "entity_id STRING, entity_type STRING, name STRING, is_hero BOOLEAN")


def found(df):
    return [tuple(r) for r in df.collect()]


def test_dedup_keeps_evidence_over_a_better_claim_without(spark):
    df = edges.deduplicated(claims(spark, [("a", "P", "b", 3, 0.8, "e1"), ("a", "P", "b", 3, 0.9, "")]))
    r = df.first()
    assert (r["mentions"], r["confidence"], r["evidence"]) == (2, 0.9, "e1")
    assert found(edges.deduplicated(df.select(F.lit("x").alias("claim_id"), "src", "predicate", "dst", "ch", "confidence", "evidence")).select("confidence", "evidence")) == [(0.9, "e1")]


def test_symmetric_predicates_are_ordered(spark):
    df = edges.symmetric(simple(spark, [("b", "KIN", "a", 1), ("b", "P", "a", 1)]), ["KIN"])
    assert sorted(found(df.select("predicate", "src", "dst"))) == [("KIN", "a", "b"), ("P", "b", "a")]


def test_cumulative_share_is_the_upper_percentile(spark):
    df = edges.cumulative_share(spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.0,)], "v DOUBLE"), "v", "w")
    assert sorted(found(df)) == [(1.0, 0.5), (1.0, 0.5), (2.0, 0.75), (3.0, 1.0)]


def test_reversal(spark):
    rows = [("x", "FRIEND", "y", 2), ("x", "BETRAYED", "y", 9), ("p", "BETRAYED", "q", 2), ("p", "FRIEND", "q", 9)]
    got = {r["anchor_id"]: (r["severity"], r["ch"]) for r in rules.reversal(simple(spark, rows), ["FRIEND"], ["BETRAYED"]).collect()}
    assert got == {"x": ("high", 9), "p": ("medium", 9)}


def test_after_death(spark):
    r = rules.after_death(simple(spark, [("k", "KILLED", "v", 5), ("v", "SERVED", "z", 6), ("v", "FOUGHT", "w", 7)])).collect()
    assert [(x["severity"], x["anchor_id"], x["other_id"], x["ch"], x["measure"]) for x in r] == [("medium", "v", "k", 7, 1)]


def test_long_absence(spark):
    seen = spark.createDataFrame([("h", 1, 1), ("h", 2, 1), ("h", 30, 1), ("x", 1, 1), ("x", 90, 1)], "entity_id STRING, ch INT, n LONG")
    who = entities(spark, [("h", "Person", "H", True), ("x", "Person", "X", False)])
    r = rules.long_absence(who, seen, simple(spark, [("h", "P", "x", 30)])).collect()
    assert [(x["severity"], x["anchor_id"], x["claim_id"], x["ch"], x["measure"]) for x in r] == [("low", "h", "c00", 30, 27)]


@pytest.mark.parametrize("names, rows", [(["Yuncheng", "Ji Yuncheng"], 0), (["Yuncheng", "Ji Yuncheng", "Dongping"], 1)])
def test_functional_conflict_ignores_contained_names(spark, names, rows):
    places = entities(spark, [(f"p{i}", "Place", n, False) for i, n in enumerate(names)])
    c = simple(spark, [("a", "NATIVE_OF", f"p{i}", i) for i in range(len(names))])
    assert rules.functional_conflict(c, places, ["NATIVE_OF"]).count() == rows


def test_prerequisites(spark):
    pre = spark.createDataFrame([("a", "b", 20)], "src STRING, dst STRING, ch INT")
    seen = spark.createDataFrame([("a", 15, 1), ("b", 4, 1)], "entity_id STRING, ch INT, n LONG")
    assert [(r["severity"], r["measure"]) for r in rules.inverted_prerequisite(pre, seen).collect()] == [("high", 11)]
    assert rules.long_jump(pre, seen).count() == 0


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "e"), ("c", "e"), ("g", "g")], "src STRING, dst STRING")
    assert sorted(found(graph.cycles(e))) == [("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e")]
    assert sorted((r["severity"], r["measure"]) for r in rules.prerequisite_cycles(e).collect()) == [("high", 3), ("medium", 2)]
    assert graph.cycles(e.where("src = 'd'")).count() == 0


def test_standards(spark):
    who = entities(spark, [("s", "Standard", "DA/T 1-2010", True), ("n", "Standard", "DA/T 22-2015", True), ("o", "Standard", "DA/T 22-2000", False), ("x", "Standard", "GB/T 9-1994", False), ("s2", "Standard", "DA/T 2-2011", True)])
    c = simple(spark, [("s", "CITES", "o", 1), ("s", "CITES", "x", 2), ("s2", "CITES", "x", 3)])
    assert [(r["severity"], r["anchor_id"], r["other_id"], r["measure"]) for r in rules.stale_version(c, who).collect()] == [("medium", "s", "o", 15)]
    assert [(r["severity"], r["anchor_id"], r["measure"]) for r in rules.citation_gap(c, who).collect()] == [("low", "x", 2)]


def test_surprising_links_are_capped(spark):
    ranks = spark.createDataFrame([(f"e{i:03}", i) for i in range(1, 61)], "entity_id STRING, rank_no INT")
    e = spark.createDataFrame([("e001", "MET", f"e{i:03}") for i in range(40, 50)] + [("e002", "KILLED", "e050")], "src STRING, predicate STRING, dst STRING")
    labels = spark.createDataFrame([(f"e{i:03}", "x" if i < 30 else "y") for i in range(1, 61)], "node STRING, community STRING")
    r = rules.surprising_links(e, labels, ranks).collect()
    assert [(x["anchor_id"], x["other_id"], x["severity"]) for x in r] == [(f"e0{i}", "e001", "medium") for i in (40, 41, 42)]


def test_registry_takes_rules():
    rules.register_rule("X1", lambda: None)
    assert {"R1", "R2", "R3", "R4", "M1", "M2", "M3", "M4", "G1", "S1", "S2", "S3", "X1"} <= set(rules.RULES)
    del rules.RULES["X1"]


def test_codes(spark):
    names = ["GBT 18894-2016", "DAT 105一2025", "DA/T 9-94", "DAT 101-202", "plain", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, n STRING").orderBy("i")
    assert [r[0] for r in df.select(codes.standard_code(F.col("n"))).collect()] == ["GB/T 18894-2016", "DA/T 105-2025", "DA/T 9-1994", "DA/T 101", "plain", None]
    one = spark.range(1).select(
        codes.document_title(F.lit("x/GBT 18894-2016《电子文件》.pdf")), codes.renumbered(F.lit("x [3][9] y [1]"), F.lit(4)), codes.record_id(F.lit(7)), codes.record_unit(F.lit("s-012-03")),
        codes.period_start(F.lit(13), 5), codes.relative_path(F.lit("a\\..\\b//./c.TXT")), codes.file_kind(F.lit("b/c.TXT")), codes.question_key(F.lit("  who  is it?! ")),
        codes.locatable(F.lit("He said: “go home, now”."), F.lit("he… go home now")), codes.locatable(F.lit("He said: “go home, now”."), F.lit("He … go home now")),
    ).first()
    assert tuple(one) == ("电子文件", "x [1] y [2]", "ch-007", 12, 11, "a/b/c.TXT", "text", "who is it", False, True)


def test_names_match_whole_words_and_the_longest_first(spark):
    docs = spark.createDataFrame([(1, "Anne met Ann; Annette left"), (2, None), (3, "")], "doc_id LONG, text STRING")
    assert sorted(found(text.name_counts(docs, [("a", "Ann"), ("b", "Anne"), ("c", "x")]))) == [(1, "a", 1), (1, "b", 1)]


def test_segments():
    assert len(text.cut_segments(["x" * 600, "y" * 100], 500)) == 1
    assert text.cut_segments([], 500) == []
    assert [p for _, p in text.cut_segments(["a" * 450, "b" * 450, "c" * 300], 500)] == [0, 1, 2]


def test_windows(spark):
    docs = spark.createDataFrame([(1, "aaaa\nbbbb\ncc\n" + "d" * 20), (2, None)], "doc_id LONG, text STRING")
    assert sorted(found(text.windows(docs, limit=8))) == [(1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 3, 4), (2, 0, 0, 1)]


def test_picked_claims_reach_the_strongest_of_many_edges(spark):
    n = 150_000
    rows = spark.range(n).select(F.format_string("c%07d", "id").alias("claim_id"), F.lit("a").alias("src"), F.lit("KNOWS").alias("predicate"), F.format_string("e%07d", "id").alias("dst"), F.lit(1).alias("ch"), (F.col("id") / n).alias("weight"))
    got = edges.picked_claims(rows.drop("claim_id", "ch"), rows.drop("weight"), "a")
    assert [r["claim_id"] for r in got.collect()] == [f"c{n - 1 - i:07}" for i in range(48)]


def test_related_score(spark):
    e = spark.createDataFrame([("a", "z", 1.0), ("b", "z", 1.0)], "src STRING, dst STRING, weight DOUBLE")
    assert found(graph.related(e, "a")) == [("b", round(1 / math.log(3), 4), 1)]


def test_paths_and_ego(spark):
    e = spark.createDataFrame([("a", "b", 0.2), ("b", "d", 0.4), ("a", "c", 0.9), ("c", "d", 0.9), ("d", "e", 0.1)], "src STRING, dst STRING, weight DOUBLE")
    assert found(graph.shortest_paths(e, "a", "d")) == [("a>c>d", 2, 0.9), ("a>b>d", 2, 0.3)]
    assert graph.shortest_paths(e, "a", "nowhere").count() == 0
    assert sorted(r["entity_id"] for r in graph.ego(e, "a", 2).collect()) == ["a", "b", "c", "d"]
    assert [r["entity_id"] for r in graph.ego(e, "a", 1, limit=2).orderBy("hop").collect()] == ["a", "c"]


def test_best_path_is_found_among_many(spark):
    ways = [(x, y, 0.9 if i == 249 else 0.1) for i in range(250) for x, y in (("a", f"m{i:03}"), (f"m{i:03}", "z"))]
    e = spark.createDataFrame(ways, "src STRING, dst STRING, weight DOUBLE")
    assert found(graph.shortest_paths(e, "a", "z", top=1)) == [("a>m249>z", 2, 0.9)]
    assert graph.shortest_paths(e, "a", "z", top=300).count() == 250
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 0.5) for i in range(5)], "src STRING, dst STRING, weight DOUBLE")
    assert found(graph.shortest_paths(chain, "c0", "c5", max_hops=5)) == [("c0>c1>c2>c3>c4>c5", 5, 0.5)]


def test_components(spark):
    p = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y")], "a STRING, b STRING")
    got = dict(found(graph.components(p)))
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and got["y"] == "x"


def test_review(spark):
    c = simple(spark, [("a", "NATIVE_OF", "p", 1), ("a", "NATIVE_OF", "q", 2), ("a", "MET", "b", 1)])
    texts = spark.createDataFrame([(1, "a NATIVE_OF p and a, met b"), (2, "nothing")], "ch INT, text STRING")
    lost = review.unmatched(c, texts)
    assert sorted(r[0] for r in lost.collect()) == ["c01", "c02"]
    q = review.candidates(unmatched=lost, conflict=review.conflicting(c, ["NATIVE_OF"]), low=review.low_confidence(c, 0.5))
    done = spark.createDataFrame([("c02", "confirm")], "claim_id STRING, action STRING")
    assert [(r["claim_id"], r["reasons"]) for r in review.queue(q, done).collect()] == [("c01", ["unmatched", "conflict"]), ("c00", ["conflict"])]
    log = spark.createDataFrame([("c00", 1, "reject"), ("c00", 2, "reset"), ("c01", 1, "confirm"), ("c01", 3, "reject")], "claim_id STRING, seq INT, action STRING")
    now = review.folded(log, "claim_id", ["seq"])
    assert found(now) == [("c01", "reject")] and review.replayed(c, now).count() == 2
    at = {r["claim_id"]: (r["evidence_start"], r["evidence_end"]) for r in review.evidence_offsets(c, texts).collect()}
    assert at == {"c00": (0, 13), "c01": (None, None), "c02": (None, None)}


def test_files(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "path STRING, sha1 STRING")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "1"), ("d", "9"), ("e", "9")], "path STRING, sha1 STRING")
    assert {r["path"]: r["status"] for r in review.register_files(known, new).collect()} == {"a": "unchanged", "b": "replaced", "c": "duplicate", "d": "added", "e": "duplicate"}


def test_flow_values(spark):
    e = spark.createDataFrame([("a", "P", "b", 3), ("a", "p", "b", None), ("b", "P", "b", 9)], "src STRING, predicate STRING, dst STRING, support_count INT")
    f = flows.flows(e)
    assert found(f.select("src", "predicate", "dst", "value")) == [("a", "p", "b", 4)]
    assert sorted(found(flows.flow_nodes(f))) == [("dst", "b", 4), ("rel", "p", 4), ("src", "a", 4)]


def test_pages(spark):
    html = "<html><head><style>x{}</style></head><body><h1>T</h1><p>one &amp; <b>two</b><sup>1</sup></p><script>bad()</script><p>three</p><h2>U</h2><p>four</p><a href=\"/x\">l</a><a class='k' href=\"/x\">m</a></body></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>open")], "page_id LONG, html STRING")
    got = {(r["page_id"], r["unit"]): (r["title"], r["text"]) for r in pages.units_from_blocks(pages.blocks(df)).collect()}
    assert got == {(1, 1): ("T", "one & two\nthree"), (1, 2): ("U", "four"), (3, 0): (None, "open")}
    assert found(pages.links(df)) == [(1, "/x")]
    assert dict(found(df.select("page_id", pages.page_text(F.col("html")))))[3] == "open"


def test_files_of_units(spark, tmp_path):
    (tmp_path / "001.json").write_text('{"no": 1,\n "title": "A", "paragraphs": ["x", "y"]}')
    (tmp_path / "002.json").write_text("{broken")
    assert [(r["no"], r["paragraphs"]) for r in pages.read_units(spark, str(tmp_path)).collect()] == [(1, ["x", "y"])]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text('{"no": 1, "windows": [{"idx": 0, "entities": [{"name": "a", "type": "P"}], "relations": []}]}')
    assert pages.read_extractions(spark, str(tmp_path / "e")).select("no", F.col("entities")[0]["name"]).first() == (1, "a")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "g.txt").write_bytes("中文文本测试内容".encode("gbk"))
    (tmp_path / "t" / "u.txt").write_bytes("中文".encode())
    assert sorted(r["text"] for r in pages.read_texts(spark, str(tmp_path / "t")).collect()) == ["中文", "中文文本测试内容"]
    out = str(tmp_path / "w")
    for g, n in (("a", 2), ("b", 3), ("a", 1)):
        pages.write_partitioned(spark.range(n), out, g)
    assert dict(found(spark.read.parquet(out).groupBy("graph_id").count())) == {"a": 1, "b": 3}


def test_first_source_that_succeeds(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k STRING")
    one, two = (spark.createDataFrame(rows, "k STRING, content STRING") for rows in ([("a", "1"), ("b", None)], [("a", "2"), ("b", "3")]))
    assert dict(found(pages.first_success(keys, [(1, one), (2, two)], "k"))) == {"a": "1", "b": "3", "c": None}


def test_task_states(spark):
    rows = [(1, 1, "enqueue", 5), (1, 2, "claim", 0), (1, 3, "enqueue", 9), (1, 4, "fail", 0), (2, 1, "enqueue", 1), (2, 2, "done", 0), *((3, i, "fail", 0) for i in range(3))]
    got = {r["task_id"]: (r["status"], r["tries"], r["priority"]) for r in events.task_states(spark.createDataFrame(rows, "task_id INT, seq INT, action STRING, priority INT")).collect()}
    assert got == {1: ("pending", 1, 5), 2: ("done", 0, 1), 3: ("failed", 3, 0)}


def test_stream_equals_batch(spark, tmp_path):
    from conftest import SMALL

    raw = spark.read.parquet(f"{SMALL}/events.parquet")
    raw.write.parquet(str(tmp_path / "in"))
    q = events.tumbling(events.event_stream(spark, str(tmp_path / "in")), late="10000 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    batch = events.tumbling(events.with_time(raw))
    assert sorted(found(spark.table("tumbling"))) == sorted(found(batch))


def test_throttle_is_stateful(spark, tmp_path):
    import datetime as d

    t0 = d.datetime(2024, 1, 1)
    rows = [(i, t0 + d.timedelta(seconds=s), 1, "x", 0.0, "") for i, s in enumerate((0, 30, 59, 61, 100, 122))]
    spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.throttled(events.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("throttled").start()
    q.processAllAvailable()
    q.stop()
    assert [r["accepted"] for r in spark.table("throttled").orderBy("event_id").collect()] == [True, False, False, True, False, True]


# --- communities, resolution, clusters, books


def test_louvain_finds_planted_communities(spark):
    import random

    rng = random.Random(5)
    pairs = {}
    for i in range(80):
        for j in range(i):
            same = i % 4 == j % 4
            if rng.random() < (0.5 if same else 0.03):
                pairs[(f"n{j:02}", f"n{i:02}")] = 1.0
    g = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a STRING, b STRING, weight DOUBLE")
    labels = graph.communities(g)
    found = {r["node"]: r["community"] for r in labels.collect()}
    groups = {k: {found[n] for n in found if int(n[1:]) % 4 == k} for k in range(4)}
    assert all(len(v) == 1 for v in groups.values()) and len(set.union(*groups.values())) == 4
    assert graph.modularity(g, labels).first()[0] > 0.5
    empty = graph.communities(g.limit(0))
    assert empty.count() == 0


def test_resolution(spark):
    from quillgraph.operators import entities

    rows = [
        ("g", 1, 0, 0, "The Queen", "Person", ["Her Majesty"]), ("g", 1, 0, 1, "queen", "Person", None), ("g", 2, 0, 0, "Her Majesty", "Person", []), ("g", 2, 0, 1, "Queen", "Place", None),
        ("g", 3, 0, 0, "The great battle", "Event", None), ("g", 6, 0, 0, "great battle", "Event", None), ("g", 30, 0, 0, "battle", "Event", None),
        ("g", 4, 0, 0, "Thornfield", "Place", None), ("g", 5, 0, 0, "Thornfield Hall", "Place", None), ("h", 1, 0, 0, "queen", "Person", None),
    ]
    m = spark.createDataFrame(rows, "graph_id STRING, chapter INT, win INT, position INT, name STRING, entity_type STRING, aliases ARRAY<STRING>")
    got = {(r["graph_id"], r["entity_type"], r["name"]): r["canonical"] for r in entities.resolve(m).collect()}
    assert got["g", "Person", "queen"] == got["g", "Person", "Her Majesty"] == "The Queen" and got["g", "Place", "Queen"] == "Queen"
    assert got["g", "Event", "great battle"] == "The great battle" and got["g", "Event", "battle"] == "battle" and got["h", "Person", "queen"] == "queen"
    assert got["g", "Place", "Thornfield Hall"] == "Thornfield"
    scaled = {(r["graph_id"], r["entity_type"], r["name"]): r["canonical"] for r in entities.resolve_by_components(m).collect()}
    assert scaled["g", "Person", "queen"] == scaled["g", "Person", "The Queen"] == "Her Majesty" and scaled["h", "Person", "queen"] == "queen"


def test_shaping(spark):
    from quillgraph.functions import shaping

    def value(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    lit = F.lit
    assert value(shaping.roman_value(lit("mcmxciv"))) == 1994 and value(shaping.roman_value(lit(""))) == 0
    assert value(shaping.title_case(lit("THE CHILD OF THE CAVERN"))) == "The Child of the Cavern"
    assert value(shaping.squeezed_cjk(lit("中 国  ab  cd "))) == "中国 ab cd"
    assert value(shaping.spouse_key(lit("林冲之妻"))) == value(shaping.spouse_key(lit("林冲娘子"))) == "林冲#妻" and value(shaping.spouse_key(lit("林冲"))) is None
    assert [value(shaping.generic_english(lit(n))) for n in ("the servant", "The man", "Lady", "Lady Anne", "Jo", "J")] == [True, True, True, False, False, True]
    pieces = value(shaping.long_split(lit("好。" * 500 + "长" * 4000)))
    assert "".join(pieces) == "好。" * 500 + "长" * 4000 and max(map(len, pieces)) <= 1800
    assert value(shaping.long_split(lit("short"))) == ["short"]
    assert value(shaping.titles_match(lit("1.2 Angles ..... 17"), lit("Angles"))) and not value(shaping.titles_match(lit("Ab"), lit("Cd")))
    assert value(shaping.chapter_list(lit("1-3,7,2"))) == [1, 2, 3, 7]
    assert value(shaping.unfenced(lit("```json\n{}\n```"))) == "{}"
    assert [value(shaping.clamped_confidence(lit(x))) for x in ("0.5", "0", "x", "7", "-1")] == [0.5, 0.8, 0.8, 1.0, 0.0]
    assert value(shaping.entity_title(lit(3), lit("Star"), lit("Nick"), lit("r"), lit("d"))) == "No. 3 Star · Nick"
    assert value(shaping.entity_title(lit(None).cast("int"), lit(""), lit(""), lit("smith"), lit("d"))) == "smith"
    assert round(value(shaping.seeded_random(lit(42), lit(1))), 9) == 0.601103752


def test_books(spark):
    from quillgraph.sources import books

    html = "<p class='para-yuanwen'>one</p><p class='para-fanyi'>eins</p><p class='para-yuanwen'>two</p><p class='x para-fanyi'>zwei</p>"
    got = [(r["no"], r["text"], r["reference"]) for r in books.bilingual(spark.createDataFrame([(1, html), (2, None)], "page_id LONG, html STRING")).orderBy("no").collect()]
    assert got == [(1, "one", "eins"), (2, "two", "zwei")]
    lines = [("b", p, x, z) for p in range(5) for x, z in ((f"Book {p}", True), (f"text {p}", False), ("Book 1", False))]
    kept = books.without_margins(spark.createDataFrame(lines, "book STRING, page INT, line STRING, zone BOOLEAN")).count()
    assert kept == 10


def test_silhouette_and_sub_clusters(spark):
    import numpy as np
    from quillgraph.operators import clusters

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (15, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])])
    v = spark.createDataFrame([(i, r.tolist(), int(i // 15)) for i, r in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>, label INT")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, labels = 1 - u @ u.T, np.repeat([0, 1, 2], 15)
    want = np.mean([(min(d[i, labels == o].mean() for o in {0, 1, 2} - {labels[i]}) - d[i, labels == labels[i]].sum() / 14) / max(min(d[i, labels == o].mean() for o in {0, 1, 2} - {labels[i]}), d[i, labels == labels[i]].sum() / 14) for i in range(45)])
    assert abs(clusters.silhouette(v).first()[0] - want) < 1e-5
    k, _ = clusters.choose_k(clusters.reduced(v, 3), [2, 3, 4])
    assert k == 3
