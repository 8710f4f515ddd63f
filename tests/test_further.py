"""Segmentation, the vector index, upkeep of relations, capped choices and the mended limits, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from conftest import SMALL
from oracle import connect, differences
from pyspark.sql import functions as F
from quillgraph.functions import shaping
from quillgraph.operators import choice, clusters, graph, plane, segmentation, upkeep, vector_index
from quillgraph.plans import catalogue, further, more  # noqa: F401
from quillgraph.sources import contents, layout


@pytest.mark.parametrize("name", ["e_segmented", "f_indexed", "d_rejected_restored", "c_capped_links", "b_ego_edges", "l_search_rare", "j_aliases", "j_quoted", "m_sections", "m_anchors", "m_paragraphs"])
def test_query_equals_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    assert len(got) and differences(got, connect(SMALL).sql(catalogue.ORACLE[name]).df()) == ""


# --- segmentation


def plain_path(run, cost, unknown):
    """The cheapest of all ways through a run, of equal ones that with the longest first words."""
    best = None
    for cuts in itertools.product([False, True], repeat=max(0, len(run) - 1)):
        words, at = [], 0
        for i, cut in enumerate([*cuts, True], 1):
            if cut:
                words.append(run[at:i])
                at = i
        if all(w in cost or len(w) == 1 for w in words):
            key = (sum(cost.get(w, unknown) if len(w) > 1 else min(cost.get(w, unknown), unknown) for w in words), [-len(w) for w in words])
            if best is None or key < best[0]:
                best = key, words
    return best[1], best[0][0]


def test_best_path_equals_all_paths():
    rng = random.Random(3)
    for _ in range(200):
        cost = {"".join(rng.choice("天地人") for _ in range(rng.randint(1, 4))): rng.randint(1, 6) for _ in range(12)}
        run = "".join(rng.choice("天地人") for _ in range(rng.randint(1, 10)))
        assert segmentation.best_path(run, segmentation.trie(list(cost.items())), 7) == plain_path(run, cost, 7)


def test_segmented_texts(spark):
    words = spark.createDataFrame([("北京", 50), ("大学", 40), ("北京大学", 30), ("生", 20), ("大学生", 5), ("", 9), (None, 9)], "word STRING, n INT")
    texts = spark.createDataFrame([(1, "北京大学生"), (2, "北京 大学abc12生"), (3, None), (4, " \n"), (5, "生" * 4000)], "id INT, text STRING")
    got = {r["id"]: r for r in segmentation.segmented(texts, segmentation.word_costs(words), id_col="id", text_col="text").collect()}
    assert got[1]["words"] == ["北京大学", "生"] and got[1]["cost"] == sum(round(-math.log(n / 145) * 1e6) for n in (30, 20))
    assert got[2]["words"] == ["北京", "大学", "abc12", "生"] and got[3]["words"] == got[4]["words"] == [] and len(got[5]["words"]) == 4000
    kept = spark.createDataFrame([(["北京", "生", "abc", "大学"],)], "w ARRAY<STRING>").select(segmentation.content_words(F.col("w"), ["大学"])).first()[0]
    assert kept == ["北京"]
    with pytest.raises(ValueError, match="at most 2"):
        segmentation.segmented(texts, segmentation.word_costs(words), id_col="id", text_col="text", most_words=2)


def test_phrase_tokens(spark):
    text = "Mr. Darcy met Elizabeth Bennet’s sister; ELIZABETH said it's the café's Élodie to an ox"
    got = spark.createDataFrame([(text,)], "t STRING").select(segmentation.phrase_tokens(F.col("t"), ["Elizabeth Bennet", "Darcy"], ["the", "said"])).first()[0]
    assert got == ["Darcy", "met", "Elizabeth Bennet", "sister", "elizabeth", "café", "Élodie"]


# --- vector index


def clustered(n, d=12, seed=6):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(8, d))[rng.integers(0, 8, n)] * 2 + rng.normal(size=(n, d))


def brute(v, asked, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u[asked] @ u.T, 6)
    s[np.arange(len(asked)), asked] = -np.inf
    return {(int(q), int(i), r + 1) for n, q in enumerate(asked) for r, i in enumerate(np.lexsort((np.arange(len(v)), -s[n]))[:k])}


@pytest.mark.parametrize(("piece", "part"), [(8192, 4096), (40, 3)])
def test_index_is_exact_and_recalls(spark, piece, part):
    v = clustered(700)
    v[100:300] = v[100]  # one very frequent vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(4)
    index = vector_index.build(df, cells=20, sample=300, piece_rows=piece)
    assert index.rows.count() == 700
    asked = [0, 100, 350, 699, 5, 250]
    queries = df.where(F.col("vec_id").isin(asked))
    true = brute(v, asked, 10)
    got = {(r["query_id"], r["id"], r["rank"]) for r in vector_index.search(index, queries, 10, exact=True, probes=2, query_rows=part).collect()}
    assert got == true
    some = {(r["query_id"], r["id"]) for r in vector_index.search(index, queries, 10, probes=8, query_rows=part).collect()}
    assert len(some & {t[:2] for t in true}) >= 0.9 * len(true)


def test_index_of_few_or_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = vector_index.search(vector_index.build(rows), rows, 10, exact=True).collect()
    assert sorted((r["query_id"], r["id"], r["similarity"]) for r in got) == [(1, 4, 0.0), (4, 1, 0.0)]
    none = rows.limit(0)
    assert vector_index.search(vector_index.build(none), rows, 3, exact=True).count() == 0


def test_index_recall_on_the_tables(spark):
    got = catalogue.QUERIES["f_index_recall"](spark, "/root/testdata/sf0.01").toPandas()
    assert got["found"].sum() >= 0.9 * got["of"].sum()


# --- upkeep


def test_upkeep_equals_recomputation_after_any_sequence(spark):
    rng = random.Random(7)
    claims = [(i, rng.choice(["a", "b", None]), "P", rng.choice("xy"), rng.randint(1, 9), rng.choice([0.5, 0.75, 0.9, None])) for i in range(60)]
    every = spark.createDataFrame(claims, "i INT, src STRING, predicate STRING, dst STRING, ch INT, confidence DOUBLE")
    live = {i for i in range(60) if i % 3}
    state = upkeep.relation_state(every.where(F.col("i").isin(sorted(live))))
    for _ in range(4):
        out, back = set(rng.sample(sorted(live), min(len(live), 15))), set(rng.sample(sorted(set(range(60)) - live), 8))
        live = live - out | back
        now = every.where(F.col("i").isin(sorted(live)))
        new = upkeep.after_change(state, every.where(F.col("i").isin(sorted(out))), every.where(F.col("i").isin(sorted(back))), now)
        state = spark.createDataFrame(new.collect(), state.schema)
        assert sorted(map(repr, state.collect())) == sorted(map(repr, upkeep.relation_state(now).collect()))
    gone = upkeep.after_change(state, every.where(F.col("i").isin(sorted(live))), every.limit(0), every.limit(0))
    assert gone.count() == 0


# --- capped choice


@pytest.mark.parametrize("most", [None, 9])
def test_rounds_choose_what_a_pass_chooses(spark, most):
    rng = random.Random(8)
    rows = [(i, f"p{rng.randint(0, 30)}", f"c{min(rng.randint(0, 12), 4)}", rng.randint(0, 5)) for i in range(200)] + [(999, None, "c1", 9)]
    df = spark.createDataFrame(rows, "i INT, p STRING, c STRING, score INT").repartition(3)
    got = choice.capped(df, "p", "c", [F.desc("score"), F.col("i")], per_other=3, most=most)
    seen, cores, taken = set(), {}, []
    for i, p, c, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if p and p not in seen and cores.get(c, 0) < 3 and (most is None or len(taken) < most):
            seen.add(p)
            cores[c] = cores.get(c, 0) + 1
            taken.append(i)
    assert sorted(r["i"] for r in got.collect()) == sorted(taken)
    assert choice.capped(df.limit(0), "p", "c", [F.col("i")], per_other=1).count() == 0


# --- limits that are gone


def test_long_numerals_and_titles(spark):
    row = spark.createDataFrame([("M" * 1500 + "IV",)], "n STRING").select(shaping.roman_value(F.col("n"))).first()
    assert row[0] == 1_500_004
    assert spark.createDataFrame([("the house of " + "x" * 3_000,)], "n STRING").select(shaping.title_case(F.col("n"))).first()[0] == "The House of X" + "x" * 2_999


def test_communities_of_a_ring_of_cliques(spark):
    """Cliques joined in a ring: the best communities are the cliques, and no node would gain by moving."""
    edges = [(f"n{c}{a}", f"n{c}{b}", 1.0) for c in range(6) for a in range(5) for b in range(a)] + [(f"n{c}0", f"n{(c + 1) % 6}1", 1.0) for c in range(6)]
    g = spark.createDataFrame(edges, "a STRING, b STRING, weight DOUBLE")
    labels = graph.communities(g)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[f"n{c}{a}" for a in range(5)] for c in range(6)]


# --- contents and sections


def test_a_book_is_split_by_its_contents(spark):
    pages = {
        1: ["A title", "7"],
        2: ["Contents", "Chapter 1 Numbers", "1.1 Counting ..... 3", "1.2 Adding .... 9", "Chapter 2 Shapes", "2.1 Circles 14", "2.2 Squares 20", "3.1 Unlisted 30"],
        3: ["# Chapter 1 Numbers", "why we count", "## 1.1 Counting", "one two"],
        4: ["# 1.1 Counting", "three", "## 2.2 Squares", "see there"],
        5: ["# 1.2 Adding", "plus", "# 1.2 Something else", "1.2 of them"],
        6: ["# Chapter 2 Shapes", "round and square", "# 2.1 Circles", "pi"],
    }
    rows = [(b, p, 100 * p + i, line) for b in ("x", "y") for p, lines in pages.items() for i, line in enumerate(lines)]
    toc, body = contents.contents(spark.createDataFrame(rows, "book STRING, page INT, at INT, line STRING"))
    assert sorted(map(tuple, toc.where("book = 'x'").collect())) == [("x", 1, 1, 1, "Counting", "Numbers"), ("x", 2, 1, 2, "Adding", "Numbers"), ("x", 3, 2, 1, "Circles", "Shapes"), ("x", 4, 2, 2, "Squares", "Shapes")]
    got = sorted(map(tuple, contents.by_sections(body, toc).collect()))
    one = [(1, "why we count"), (1, "one two"), (1, "three"), (1, "## 2.2 Squares"), (1, "see there"), (2, "plus"), (2, "1.2 of them"), (3, "round and square"), (3, "pi")]
    assert [(r[0], r[1], r[3]) for r in got] == [(b, *x) for b in ("x", "y") for x in one]
    assert contents.by_sections(body.limit(0), toc).count() == 0


def test_aligned_headings_equal_a_loop(spark):
    rng = random.Random(11)
    rows = [(b, i, rng.randint(1, 9)) for b in range(6) for i in range(rng.randint(0, 25))]
    want = []
    for b in range(6):
        now = 0
        for _, i, seq in [r for r in rows if r[0] == b]:
            if now < seq <= now + 2:
                now = seq
                want.append((b, i, seq))
    assert sorted(map(tuple, contents.aligned(spark.createDataFrame(rows, "book INT, at INT, seq INT").repartition(3)).collect())) == want


def test_anchors_equal_a_loop(spark):
    rng = random.Random(12)
    rows = [(p, i, rng.choice(["img", "p", "p"]), f"{p}-{i}") for p in range(4) for i in range(rng.randint(0, 14))]
    want = {}
    for k, (p, i, kind, _) in enumerate(rows):
        if kind == "img":
            later, earlier = ([r[3] for r in side if r[0] == p and r[2] == "p"] for side in (rows[k + 1 :], rows[:k][::-1]))
            want[p, i] = later[:3] + earlier[:2]
    got = contents.anchors(spark.createDataFrame(rows, "page INT, at INT, kind STRING, text STRING").repartition(3)).collect()
    assert {(r["page"], r["at"]): r["anchors"] for r in got} == want


# --- lines and paragraphs of boxes


def plain_lines(boxes):
    out = {}
    for page in sorted({b[:2] for b in boxes}):
        lines = []
        for _, _, x, w, top, size, text in sorted((b for b in boxes if b[:2] == page and b[6].strip()), key=lambda b: (b[4], b[2], b[3], b[5], b[6])):
            if lines and abs(top - lines[-1][0]) <= 0.55 * min(size, lines[-1][1]):
                lines[-1][2].append((x, w, text, size))
            else:
                lines.append((top, size, [(x, w, text, size)]))
        for n, (top, size, items) in enumerate(lines):
            text, end = "", None
            for x, w, t, _ in sorted(items):
                text += (" " if end is not None and x - end > 0.3 * size and not text.endswith(" ") else "") + t
                end = x + w
            out[(*page, n)] = text, top, max(i[3] for i in items), min(i[0] for i in items), max(i[0] + i[1] for i in items)
    return out


def test_lines_equal_a_loop(spark):
    rng = random.Random(13)
    boxes = [(b, p, float(rng.randint(0, 300)), float(rng.randint(5, 40)), rng.randint(0, 200) / 2, float(rng.choice([8, 10, 14])), rng.choice(["ab", "c", " ", "d "])) for b in range(2) for p in range(3) for _ in range(30)]
    got = layout.lines_of_boxes(spark.createDataFrame(boxes, "book INT, page INT, x DOUBLE, w DOUBLE, top DOUBLE, size DOUBLE, text STRING").repartition(3)).collect()
    assert {(r["book"], r["page"], r["line"]): (r["text"], r["top"], r["size"], r["x0"], r["x1"]) for r in got} == plain_lines(boxes)


def test_paragraphs_open_where_they_should(spark):
    texts = [  # page, top, x0, x1, text
        (1, 10, 0, 100, "first line"), (1, 22, 0, 100, "goes on"), (1, 34, 0, 50, "and ends early"), (1, 46, 0, 100, "a new one"), (1, 80, 0, 100, "far below."),
        (1, 92, 20, 100, "indented after an end"), (1, 104, 20, 100, "indented again"), (2, 10, 0, 100, "next page"), (2, 22, 0, 100, "1.2 clause"), (2, 34, 0, 100, "中文"), (2, 46, 0, 100, "接着"),
    ]
    rows = [("b", p, i, t, float(top), 10.0, float(a), float(b)) for i, (p, top, a, b, t) in enumerate(texts)]
    lines = spark.createDataFrame(rows, "book STRING, page INT, line INT, text STRING, top DOUBLE, size DOUBLE, x0 DOUBLE, x1 DOUBLE")
    got = [r["text"] for r in layout.paragraphs(lines).orderBy("no").collect()]
    assert got == ["first line goes on and ends early", "a new one", "far below.", "indented after an end indented again next page", "1.2 clause 中文接着"]
    assert layout.paragraphs(lines.limit(0)).count() == 0


# --- names


def test_names_that_mean_nobody(spark):
    def told(names, kind, english=False):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, n STRING").orderBy("i")
        return [r[0] for r in df.select(shaping.generic_name(F.col("n"), kind, english)).collect()]

    assert told(["林冲", "两个都头", "都头", "众好汉", "他们", "冲", None, "大小头领", "李逵等人"], "novel") == [False, True, True, True, True, True, True, True, True]
    assert told(["圆", "例1", "练习 2", None, "", "三角形"], "textbook") == [False, True, True, True, True, False]
    assert told(["归档文件", "本标准", "本章", "附录A", "表 A1", "图2", "第三章", "注", "本地"], "topic") == [False, True, True, True, True, True, True, True, False]
    assert told(["Mr. Darcy", "the servant", "The  old man", "His Majesty", "Miss", "X", "林冲", "My aunt"], "novel", True) == [False, True, True, False, True, True, False, True]


def test_names_of_wives(spark):
    names = ["林冲娘子", "林冲的娘子", "林冲之妻", "林冲妻子", "林冲浑家", "的妻", "妻", "林冲", "一二三四五妻", "一二三四的妻", None]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, n STRING").orderBy("i").select(shaping.spouse_key(F.col("n"))).collect()
    assert [r[0] for r in got] == ["林冲#妻"] * 5 + ["的#妻", None, None, None, "一二三四#妻", None]


# --- the neighbourhood map


def kept_neighbours(v, at, k=10):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    d = -((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d, -np.inf)
    a, b = np.argsort(-s, axis=1)[:, :k], np.argsort(-d, axis=1)[:, :k]
    return np.mean([len(set(x) & set(y)) / k for x, y in zip(a, b, strict=True)])


def test_the_map_keeps_neighbours_better_than_two_components(spark):
    v = clustered(160, d=16, seed=14)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    start = clusters.plane(df).select(F.col("vec_id").alias("id"), (F.col("x") / 9.5).alias("x"), (F.col("y") / 9.5).alias("y")).cache()
    got = plane.neighbourhood_plane(df, start, k=10, rounds=12)
    before, after = ([(r["x"], r["y"]) for r in d.orderBy("id").collect()] for d in (start, got))
    assert len(after) == 160 and kept_neighbours(v, np.array(after)) > 1.25 * kept_neighbours(v, np.array(before))


def test_weights_count_as_many_neighbours(spark):
    rows = [(q, i, 1 - 0.01 * (abs(q - i))) for q in range(12) for i in range(12) if 0 < abs(q - i) <= 4]
    got = {(r["a"], r["b"]): r["weight"] for r in plane.fuzzy_weights(spark.createDataFrame(rows, "query_id INT, id INT, similarity DOUBLE"), 8).collect()}
    assert all(0 < w <= 1 for w in got.values()) and got[5, 6] == pytest.approx(1) and got[5, 6] > got[5, 7] > got[5, 9]
