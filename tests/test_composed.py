"""Material of answers, boards, views, media and seeds on small tables: plain loops, nulls, ties, empty tables."""

from __future__ import annotations

import random

from quillgraph.operators import board, contain, evidence, views
from quillgraph.sources import media

CLAIM = "claim_id STRING, src STRING, predicate STRING, dst STRING, ch INT"


def plain_gather(question, names, weight, claims, most=40, each_least=6, per_pair=8, enough=24):
    """The same by loops over one question."""
    found = sorted((question.index(n), e) for e, n in names if n and n in question)
    who = [e for _, e in found][:4]
    ids, about = [], {}
    for i, a in enumerate(who):
        for b in who[i + 1 :]:
            if len(ids) < enough:
                new = sorted({c[0] for c in claims if {c[1], c[3]} == {a, b}})[:per_pair]
                ids += new
                for c in new:
                    about.setdefault(c, f"{a} {b}")
    facts = list(dict.fromkeys(ids))
    each = max(each_least, (most - len(facts)) // len(who)) if who else 0
    for e in who:
        turns = []
        for edge in {c[1:4] for c in claims if e in (c[1], c[3])}:
            for turn, c in enumerate(sorted((c for c in claims if c[1:4] == edge), key=lambda c: (c[4], c[0]))[:2]):
                turns.append((turn, -weight[edge], edge, c[0]))
        for *_, c in sorted(turns)[:each]:
            if c not in about and len(facts) < most:
                about[c] = e
                facts.append(c)
    return [(n, c, about[c]) for n, c in enumerate(facts[:most], 1)]


def test_gather(spark):
    rng = random.Random(3)
    people = [(f"e{i}", f"name{i:02d}") for i in range(12)]
    claims = [(f"c{i:04d}", f"e{rng.randrange(6)}", rng.choice("pq"), f"e{rng.randrange(12)}", rng.randrange(9)) for i in range(600)]
    weight = {c[1:4]: rng.randrange(50) / 10 for c in claims}
    asked = [(1, "name03 and name01"), (2, "name05 name02 name00 name04 name01"), (3, "name11?"), (4, "nobody"), (5, None), (6, ""), (7, "name10 with name11")]
    q = spark.createDataFrame(asked, "id INT, text STRING")
    n = spark.createDataFrame([*people, ("none", None), ("void", "")], "id STRING, text STRING")
    m = spark.createDataFrame([(*k, w) for k, w in weight.items()], "src STRING, predicate STRING, dst STRING, weight DOUBLE")
    got = evidence.gather(q, n, m, spark.createDataFrame(claims, CLAIM)).collect()
    for i, text in asked:
        want = plain_gather(text or "", people, weight, claims)
        assert sorted((r["n"], r["claim_id"], r["about"]) for r in got if r["question_id"] == i) == want, i
    assert {r["question_id"] for r in got} == {1, 2, 3, 7}
    assert evidence.gather(q.limit(0), n, m, spark.createDataFrame([], CLAIM)).count() == 0


def test_board(spark):
    rows = [("a", 2, ["x", "y", "z", "w"], ["p", "q", "r"], 5, 400), ("a", 10, ["y"], None, None, None), ("b", 2, None, [], 0, 2000)]
    p = spark.createDataFrame(rows, "label STRING, unit INT, persons ARRAY<STRING>, places ARRAY<STRING>, found INT, chars INT")
    got = {(r["label"], r["panel"], r["key"]): (r["n"], r["rank"]) for r in board.board(p).collect()}
    assert got["a", "units", "2"] == (1, 1) and got["a", "units", "10"] == (1, 2)
    assert got["a", "persons", "y"] == (2, 1) and ("a", "persons", "w") not in got and ("a", "places", "r") not in got
    assert got["a", "names", "4-6"] == (1, 3) and got["a", "names", "0-1"] == (1, 1) and got["b", "names", "2-3"] == (0, 2)
    assert got["b", "sizes", "900+"] == (1, 5) and got["a", "sizes", "0-399"] == (1, 1)
    assert board.board(p.limit(0)).count() == 0


def test_tags(spark):
    c = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 9), (2, "a", 1)], "id INT, entity_id STRING, n INT")
    assert {r["id"]: (r["tags"], r["found"]) for r in board.tags(c, 2).collect()} == {1: (["c", "a"], 3), 2: (["a"], 1)}


def test_drift(spark):
    words = [("a", "part 10", "x", 1), ("a", "part 2", "x", 1), ("a", "part 2", "y", 2), ("a", "part 10", "z", 2), ("b", "none", "k", 1)]
    found = board.changed_words(spark.createDataFrame(words, "label STRING, period STRING, word STRING, rank INT"))
    got = {(r["label"], r["period"]): (r["words"], r["fresh"], r["gone"], r["turnover"]) for r in found.collect()}
    assert got == {("a", "part 2"): (["x", "y"], [], [], 0.0), ("a", "part 10"): (["x", "z"], ["z"], ["y"], round(2 / 3, 4)), ("b", "none"): (["k"], [], [], 0.0)}
    size = spark.createDataFrame([("a", "part 2", 3, 1.0), ("a", "part 10", 4, 0.5), ("b", "none", 4, 1.0)], "label STRING, period STRING, count INT, share DOUBLE")
    points = found.join(size, ["label", "period"]).selectExpr("*", "turnover > 0.5 AS significant")
    text = {r["label"]: r["text"] for r in board.report(points, spark.createDataFrame([("a", "First")], "label STRING, name STRING")).collect()}
    assert text["a"] == "## First\n\n- **part 2**: 3 (100.0%), x, y\n- **part 10**: 4 (50.0%), x, z; new: z (marked change)"
    assert text["b"].startswith("## b\n")
    snap = {r["period"]: (r["clusters"], r["fresh"], r["gone"]) for r in board.snapshot(points).collect()}
    assert snap["part 10"] == (["a"], ["z"], ["y"]) and snap["none"] == (["b"], [], [])


def test_search_all(spark):
    rows = [("g", f"e{i}", n, c) for i, (n, c) in enumerate([("Ann", 1), ("Anna", 9), ("Joann", 99), ("Bob", 5), (None, 1)])] + [("h", "e9", "ann", 0)]
    e = spark.createDataFrame(rows, "graph_id STRING, entity_id STRING, name STRING, claim_count INT")
    assert [(r["graph_id"], r["name"]) for r in views.search_all(e, " Ann ", 2).orderBy("graph_id", "rank").collect()] == [("g", "Ann"), ("g", "Anna"), ("h", "ann")]
    assert views.search_all(e, "  ").count() == 0


def test_visible(spark):
    nodes = spark.createDataFrame([("a", "p", 1900), ("b", "p", 1700), ("c", "p", None), ("d", "event", 1900), ("e", "p", 1900), (None, "p", 1900)], "entity_id STRING, kind STRING, year INT")
    links = spark.createDataFrame([("a", "b", "kin"), ("a", "c", "foe"), ("d", "a", "part"), ("c", "c", None)], "src STRING, dst STRING, kind STRING")

    def ids(**how):
        return sorted(r["entity_id"] or "" for r in views.visible(nodes, links, **how).collect())

    assert ids() == ["", "a", "b", "c", "d", "e"]
    assert ids(focus="a") == ["a", "b", "c", "d"] and ids(focus="b", years=(1800, 2000)) == ["a", "b"]
    assert ids(years=(1800, 2000)) == ["", "a", "c", "d", "e"]
    assert ids(hidden=["kin", "foe"]) == ["", "a", "c", "d", "e"]  # c has a link of no kind, e none at all
    assert ids(hidden=["part"], carried={"event": "part"}) == ["", "a", "b", "c", "e"]


def test_kept_points_and_names(spark):
    p = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id INT, label INT")
    hits = spark.createDataFrame([(3,), (3,)], "id INT")
    assert sorted(r["id"] for r in views.kept_points(p, p["label"] == 0, hits).collect()) == [1, 3]
    assert views.kept_points(p).count() == 3 and views.kept_points(p, p["label"] == 1).count() == 1
    words = spark.createDataFrame([(0, "fr", "zero"), (0, "fr", "alpha"), (1, "de", "eins"), (None, "fr", "x")], "code INT, locale STRING, shown STRING")
    rows = p.selectExpr("id", "label", "'own' AS name")
    assert {r["id"]: r["name"] for r in views.localized(rows, words, "fr", "label", "name").collect()} == {1: "alpha", 2: "own", 3: "own"}


def test_media(spark):
    pics = [("n", 3, "s3", "commons", None), ("n", 1, "s1", None, False), ("n", 2, "s2", "book", True), ("n", 9, "s1", "commons", True), ("m", 1, "a", "book", None), ("m", 2, "b", "commons", None), (None, 1, "x", None, None), ("o", 1, None, None, None)]
    g = media.galleries(spark.createDataFrame(pics, "name STRING, ord INT, src STRING, source STRING, solo BOOLEAN"))
    assert {r["name"]: (r["gallery"], r["avatar"]) for r in g.collect()} == {"n": (["s1", "s2", "s3"], "s2"), "m": (["a", "b"], "b")}
    rows = spark.createDataFrame([("n", "old"), ("z", "old"), (None, "old")], "name STRING, media STRING")
    got = media.with_media(rows, g.selectExpr("name", "avatar AS media"), "name")
    assert {r["name"]: r["media"] for r in got.collect()} == {"n": "s2", "z": None, None: None}


def test_seeds(spark):
    files = [
        (1, "Rules of filing（2019版）", "GB/T 18894-2016", "std", True, None), (2, "State secrets law", None, "law", True, ""), (3, "Broken", None, "x", True, "bad"),
        (4, "Not yet", None, "x", None, None), (5, "Plain", "", None, True, None), (6, None, None, "x", True, None),
    ]
    got = media.manifest_seeds(spark.createDataFrame(files, "no INT, title STRING, code STRING, category STRING, converted BOOLEAN, error STRING"), "State ")
    assert {r["no"]: (r["name"], r["aliases"], r["description"]) for r in got.collect()} == {
        1: ("GB/T 18894-2016", ["Rules of filing", "GB/T 18894"], "Rules of filing"), 2: ("State secrets law", ["secrets law"], ""), 5: ("Plain", [], ""),
    }
    seeds = spark.createDataFrame([(1, "Ann", "Person", ["Annie"]), (2, "Bob", "Person", None), (3, "York", "Place", [])], "seed_id INT, name STRING, entity_type STRING, aliases ARRAY<STRING>")
    texts = spark.createDataFrame([("t", "Bob met Annie"), ("u", "York"), ("v", None)], "id STRING, text STRING")
    said = seeds.selectExpr("seed_id AS id", "explode(concat(array(name), coalesce(aliases, array()))) AS text")
    hints = {r["id"]: r["hint"] for r in media.seed_hints(seeds, contain.contained(said, texts)).collect()}
    assert hints == {"t": "- Ann (Person), also Annie\n- Bob (Person)", "u": "- York (Place)"}
