"""Substring deduplication, vector codes and hard negatives: SQL on the tables, brute force on edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from oracle import connect, differences
from pyspark.sql import functions as F
from quillgraph.llm import hard_negatives, queries, substring_dedup, vector_codes


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_vector_codes", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    assert len(got) and differences(got, connect(SMALL).sql(queries.oracle_sql()[name]).df()) == ""


# --- substring deduplication


def plain_dedup(docs, window=13):
    """(id, words, removed, kept) of (id, text) by comparing all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            if i is not None and (run not in first or i < first[run]):
                first[run] = i
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            f = first.get(tuple(w[k : k + window]))
            if f is not None and (i is None or f < i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def dedup(spark, docs):
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").withColumn("doc", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("words", F.lit(2.0)).repartition(3)
    return sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(df).collect()), key=repr)


def made_up(seed):
    """Texts with shared passages, edits within them, branches, copies, blanks of all kinds, and few distinct words."""
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(40)] + ["é中", "x" * 300, "don't"]
    passages = [[rng.choice(v) for _ in range(rng.randint(12, 90))] for _ in range(6)]
    docs = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages))
            p = p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)]
            for _ in range(rng.randint(0, 2)):
                p[rng.randrange(len(p))] = rng.choice(v)
            w += p + [rng.choice(v) for _ in range(rng.randint(0, 9))]
        docs.append((i, "".join(x + rng.choice([" ", "  ", "\t", "\n", "\r\n", "\x0b\x0c"]) for x in w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    docs = made_up(seed)
    got = dedup(spark, docs)
    assert got == plain_dedup(docs) and sum(r[2] for r in got) > 500


def test_repeats_in_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    same = "same " * 5000
    docs = [
        (None, passage), (None, passage + " more"), (7, passage + " seven"), (7, "other " + passage), (9, None), (10, ""), (11, " \t\n"), (12, same), (13, same), (3, "same " * 13), (20, "w x " * 20), (21, "w x " * 13),
        (22, " ".join(f"p{i}" for i in range(12))), (23, " ".join(f"p{i}" for i in range(13))), (30, passage), (30, passage),
    ]
    got = dedup(spark, docs)
    assert got == plain_dedup(docs)
    assert (30, 60, 60, "") in got and (7, 61, 0, passage + " seven") in got and (None, 60, 60, "") in got and (22, 12, 0, " ".join(f"p{i}" for i in range(12))) in got


def test_repeats_in_an_empty_table(spark):
    assert dedup(spark, []) == [] and dedup(spark, [(1, None)]) == [(1, 0, 0, "")]


def test_words_of_a_batch():
    texts = ["a b", "", None, "c", " d  e ", "é 中", "f"]
    w = substring_dedup.Words(pa.array(texts, pa.string())[1:])
    assert [bytes(w.data[x:y]).decode() for x, y in zip(w.starts, w.ends, strict=True)] == ["c", "d", "e", "é", "中", "f"]
    assert w.doc.tolist() == [2, 3, 3, 4, 4, 5] and w.first.tolist() == [0, 0, 0, 1, 3, 5, 6]
    again = substring_dedup.Words(pa.array(["zz c", "d e f é 中"], pa.string())).hashes()
    assert w.hashes().tolist() == again[[1, 2, 3, 5, 6, 4]].tolist()


def test_a_task_speaks_once_for_a_frequent_gram(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD_ROWS", 50)  # flushed often
    docs = made_up(3)
    assert dedup(spark, docs) == plain_dedup(docs)


# --- vector codes


def plain_codes(rows, entries, rounds=4, parts=4):
    """({id: (code, error)}, digest) by comparing every part with every entry, in Python's integers."""
    kept = sorted((i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows)
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            member = {}
            for _, v in kept:
                member.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(member[k]) for c in zip(*member[k], strict=True)] if k in member else e for k, e in enumerate(books[p])]
    found = {i: [near(cut(v, p), books[p]) for p in range(parts)] for i, v in kept}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, digest


VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def test_codes_equal_brute_force_and_ties_go_to_the_lower_index(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 16) / 1024 * 40]) for i in range(60)] + [(100 + i, [0.0] * 16) for i in range(3)]
    df = spark.createDataFrame([(i, v, i % 3 if i % 5 else None) for i, v in rows], VECTORS).withColumn("code", F.lit("clash")).repartition(3)
    books = vector_codes.fit(df, entries=8)
    got = {r["vec_id"]: tuple(r["coded"]) for r in vector_codes.encode(df, books).collect()}
    assert (got, books.digest()) == plain_codes(rows, 8)


@pytest.mark.parametrize("width", [3, 5, 8, 16, 32])
def test_bounds_lose_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    for spread in (1, 3, 1000, 1 << 20):
        rows, book = rng.integers(-spread, spread + 1, (300, width)), rng.integers(-spread, spread + 1, (50, width))
        index, far = vector_codes.nearest(rows, book)
        every = ((rows[:, None] - book[None]) ** 2).sum(2)
        assert (far == every.min(1)).all() and (index == every.argmin(1)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 0), (4, [nan, 0.0, 0.0, 0.0], 0), (5, [inf, 0.0, 0.0, 0.0], 0), (0, [0.1, 0.2, 0.3, 0.4], None), (6, [0.1, 0.2, 0.3], None), (None, [0.5, 0.2, 0.3, 0.4], None), (7, [0.1, 0.2, 0.3, 0.4], 1), (7, [0.1, 0.2, 0.3, 0.4], 1), (8, [3e38, -3e38, 0.0, 0.0], 1)]
    df = spark.createDataFrame(odd, VECTORS)
    books = vector_codes.fit(df, entries=3)
    coded = vector_codes.encode(df, books).select("vec_id", "label", "coded.code", "coded.error")
    got = {r["vec_id"]: r for r in vector_codes.with_label_error(coded).collect()}
    assert set(got) == {0, 2, 6, 7, 8, None} and coded.count() == 7
    assert got[0]["code"] == got[7]["code"] and got[6]["code"] is None and got[2]["error"] is None and got[8]["error"] is not None
    assert got[0]["label_error"] == got[None]["label_error"] == got[0]["error"] + got[None]["error"]
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.encode(empty, vector_codes.fit(empty)).count() == 0


# --- hard negatives


def plain_negatives(rows, anchors, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], g) for i, v, g in rows]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, g) in enumerate(kept):
        if i is None or not anchors(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, h == g) for b, (j, w, h) in enumerate(kept) if b != a]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, pid, k + 1, n[1], p, n[0]) for k, n in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 2048])
def test_negatives_equal_brute_force(spark, block):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(4, 24))
    rows = [(i, [float(x) for x in np.float32((centre[i % 4] + rng.normal(size=24)) / 8)], i % 3) for i in range(120)]
    rows += [(200 + i, rows[0][1], i % 2) for i in range(15)] + [(5, rows[5][1], 2), (5, rows[5][1], 2), (None, rows[10][1], 0), (None, rows[20][1], 1), (250, [0.0] * 24, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("clash")).withColumn("score", F.lit(1)).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, block_anchors=block, sample_rows=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_negatives(rows, lambda i: i % 5 == 0) != []


def test_negatives_of_odd_rows(spark):
    odd = [(0, [1.0, 0.0], 0), (5, [0.9, 0.1], 0), (10, [0.7, 0.2], 1), (11, [0.6, 0.2], None), (12, None, 1), (13, [float("nan"), 0.0], 1), (14, [0.7], 1), (15, [], 1)]
    got = hard_negatives.mine(spark.createDataFrame(odd, VECTORS), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives([odd[0], odd[1], odd[2]], lambda i: i % 5 == 0)
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [0.5, 0.5], 1)], VECTORS), F.col("vec_id") % 5 == 0).count() == 0
