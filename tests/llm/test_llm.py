"""The training-data operators on small fixtures: brute force, exact round trips, held-out accuracy, and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from oracle import connect, differences
from pyspark.sql import functions as F
from quillgraph.llm import _common, chat, decontaminate, language_id, masked_lm, order_minhash, packing, quality, queries, toxicity, transport_stream, url_filter

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score DOUBLE, media BINARY, node STRING, language STRING"
LONG_TEXT = "word " * 60_000


def table(spark, texts, lang="en"):
    """Documents with clashing extra columns; a text may be (id, text) or a text alone."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", None, 0.5, b"x", "n", "l") for i, t in rows], DOCS)


ODD = [None, "", " ", "!!! ...", "Ärger 中文 ñ", "same text twice", "same text twice", LONG_TEXT, (5, "same text twice"), (None, "no id")]


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# --- transport streams


@pytest.mark.parametrize("size", [0, 1, 150, 151, 152, 170, 184, 191, 192, 3072, 3073, 50_000])
def test_stream_round_trip(size):
    data = random.Random(size).randbytes(size)
    d = transport_stream.demux(transport_stream.mux(data))
    (s,) = d["streams"]
    assert s["payload"] == data and s["stream_type"] == 6 and d["continuity_errors"] == d["bad_packets"] == s["broken_units"] == 0
    assert d["programs"] == [{"program": 1, "pmt_pid": 0x1000, "streams": [{"pid": 0x100, "stream_type": 6}]}]
    assert [u["pts"] for u in s["units"]] == [3600 * i for i in range(len(s["units"]))]
    assert [i for i, u in enumerate(s["units"]) if u["random_access"]] == list(range(0, len(s["units"]), 8))
    assert [u["offset"] for u in s["units"]] == list(range(0, max(1, size), 3072))


def test_stream_damage():
    media = transport_stream.mux(b"x" * 20_000)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = transport_stream.demux(b"".join(packets[:10] + packets[11:]))
    assert lost["continuity_errors"] == 1 and lost["streams"][0]["broken_units"] == 1
    assert len(lost["streams"][0]["payload"]) < 20_000
    twice = transport_stream.demux(b"".join(packets[:10] + packets[9:]))
    assert twice["continuity_errors"] == 0 and twice["streams"][0]["payload"] == b"x" * 20_000
    bad = transport_stream.demux(b"".join(packets[:10] + [b"\x00" + packets[10][1:]] + packets[11:]))
    assert bad["bad_packets"] == 1 and bad["continuity_errors"] == 1
    assert transport_stream.demux(None) == transport_stream.demux(b"") == {"packets": 0, "bad_packets": 0, "continuity_errors": 0, "clock_references": 0, "programs": [], "streams": []}


def test_stream_query(spark, tmp_path):
    table(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op1_transport_stream(spark, str(tmp_path)).collect()
    texts = Counter(((r["doc_id"], r["text"]) for r in table(spark, ODD).collect()))
    assert len(rows) == sum(texts.values())
    by_sha = {(r["payload_sha256"], r["n_bytes"]): r for r in rows}
    for _, text in texts:
        raw = (text or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = by_sha[hashlib.sha256(padded).hexdigest(), len(raw)]
        assert (r["payload_bytes"], r["tail_crc32"]) == (len(padded), zlib.crc32(padded[-16:]))
        assert r["media_sha256"] == hashlib.sha256(transport_stream.mux(padded)).hexdigest()


# --- decontamination


def brute_hits(text, items, size):
    w = decontaminate.words(text.encode() if text is not None else None)
    hit, owners = set(), set()
    for item, t in items:
        for win in decontaminate.windows(t.encode() if t is not None else None, size):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    owners.add(str(item))
    return len(w), len(hit), sorted(owners)


@pytest.mark.parametrize("block", [3, 200_000])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "d", "rare", "Ünï"]
    texts = [words(rng, rng.randint(0, 40), vocabulary) for _ in range(40)] + ODD[:9]
    items = [(i, words(rng, rng.randint(0, 9), vocabulary)) for i in range(12)] + [(50, None), (51, ""), (52, "SAME text"), (52, "a b c"), (53, "a b c")]
    bench = spark.createDataFrame([*items, (None, "a")], "item_id LONG, text STRING")
    got = decontaminate.decontaminate(table(spark, texts), bench, window=4, block_windows=block)
    rows = Counter((r["text"], r["leaks"]["n_words"], sum(s["past"] - s["first"] for s in r["leaks"]["spans"]), tuple(r["leaks"]["items"])) for r in got.collect())
    want = Counter()
    for t in table(spark, texts).collect():
        n, hit, owners = brute_hits(t["text"], items, 4)
        want[(t["text"], n, hit, tuple(owners))] += 1
    assert rows == want


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    assert decontaminate.decontaminate(table(spark, ODD), none).where("size(leaks.items) > 0").count() == 0
    assert decontaminate.decontaminate(table(spark, []), none).count() == 0


def test_decontamination_query_equals_sql(spark):
    got = queries.op3_decontaminate(spark, SMALL).toPandas()
    assert differences(got, connect(SMALL).sql(queries.OP3_SQL).df()) == ""
    assert got["contaminated"].any()


# --- URLs


def test_urls(spark):
    cases = {
        None: ("", ""), "": ("", ""), "no scheme": ("", ""), "HTTP://WWW.Example.ORG/es/1?x#y": ("www.example.org", "/es/1"), "a://b": ("b", ""), "a://b?c/d": ("b", ""),
        "x://Ä.com/de/://z": ("Ä.com", "/de/://z"), "a://org/": ("org", "/"), "a://b\n/c\nd#e": ("b\n", "/c\nd"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id LONG, url STRING")
    host, path = url_filter.split_url(F.col("url"))
    assert [(r[0], r[1]) for r in df.orderBy("page_id").select(host, path).collect()] == list(cases.values())


def test_url_rules_and_method(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = {"http://a.example.org/es/5": "example.org/es/", "http://example.org/en/17": "example.org/en/1", "http://example.org/en/2": "org/", "http://org/": "org/", "http://xorg/": None, "http://forg.com/fr/": "com/fr/", "http://a.org": None, "http://a.com/de/1": "com/de/"}
    train = [f"http://good{i}.org/reading/{i}" for i in range(60)] + [f"http://spam{i}.com/de/casino-{i}" for i in range(60)]
    asked = ["http://x.net/reading/7", "http://casino-win.net/casino-1", None, ""]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, *train, *asked])], "page_id LONG, url STRING, verdict STRING")
    got = {r["url"]: r for r in url_filter.filter_urls(df, rules).collect()}
    assert {u: got[u]["rule"] for u in urls} == urls
    assert got["http://x.net/reading/7"]["verdict"] == "allow" and got["http://casino-win.net/casino-1"]["verdict"] == "block"
    assert got[None]["verdict"] == got[""]["verdict"] == "allow"
    assert {r["verdict"] for r in url_filter.filter_urls(df.where("url LIKE '%reading%'"), [("allow", "org/")]).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_smoothed_tables_are_distributions():
    rng = np.random.default_rng(0)
    counts = np.zeros(url_filter.ALPHABET ** (url_filter.ORDER + 1), np.int64)
    counts[rng.integers(0, len(counts), 500)] += 3
    p = np.exp(url_filter.smoothed(counts)).reshape(-1, url_filter.ALPHABET)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and (p > 0).all()


# --- quality, toxicity, language: models


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def labelled(spark, good, bad, column):
    rng = random.Random(4)
    texts = [good(rng) for _ in range(300)] + [bad(rng) for _ in range(120)]
    docs = table(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(420) if i % 5] + [(3, None), (None, 1), (9999, 1)], f"doc_id LONG, {column} INT")
    return docs, labels, texts


def test_quality_on_held_out_rows(spark):
    v = [f"w{i}" for i in range(400)]
    docs, labels, texts = labelled(spark, lambda r: words(r, 20, ["buy", "now"]).upper() + "!!!", lambda r: words(r, 80, v) + ".", "quality")
    model = quality.fit(docs, labels)
    got = [(r["doc_id"], r["text"], r["quality_score"]) for r in quality.score(docs, model).collect()]
    held = [(s, i >= 300) for i, t, s in got if i is not None and i % 5 == 0 and i < 420 and t == texts[i]]
    assert sum((s >= 0.3) == y for s, y in held) / len(held) > 0.95
    by_text = {}
    for _, t, s in got:
        assert 0 <= s <= 1 and by_text.setdefault(t, s) == s
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    assert {r[0] for r in quality.score(docs, quality.fit(docs, none)).select("quality_score").distinct().collect()} == {0.5}
    one = labels.where("quality = 1")
    assert {r[0] for r in quality.score(docs, quality.fit(docs, one)).select("quality_score").distinct().collect()} == {1.0}
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    v = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    bad = ["idiot", "scummy", "moronic", "loseri"]
    docs, labels, texts = labelled(spark, lambda r: words(r, 60, v), lambda r: words(r, 30, v) + f" {r.choice(bad)}{r.choice('abc')} " + words(r, 30, v) + f" {r.choice(bad)}", "toxic")
    model = toxicity.fit(docs, labels)
    got = [(r["doc_id"], r["text"], r["toxicity"]["score"]) for r in toxicity.score(docs, model).collect()]
    held = [(s, i >= 300) for i, t, s in got if i is not None and i % 5 == 0 and i < 420 and t == texts[i]]
    assert sum((s >= 0.3) == y for s, y in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for *_, s in got)
    assert all(s < 0.3 for _, t, s in got if t in ODD)
    none = spark.createDataFrame([], "doc_id LONG, toxic INT")
    assert {r[0] for r in toxicity.score(docs, toxicity.fit(docs, none)).select("toxicity.score").distinct().collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == toxicity.fit(docs.limit(0), labels).constant == 0


def test_label_model_finds_accurate_and_correlated_voters():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    flip = lambda p: y ^ (rng.random(len(y)) < p)
    votes = np.stack([flip(0.05), flip(0.1), flip(0.1), flip(0.3), rng.random(len(y)) < 0.5], 1).astype(np.int64)
    votes = np.hstack([votes, votes[:, 3:4]])  # a copy of a weak voter must not outvote the good ones
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q = toxicity.label_model(patterns, counts.astype(float), np.where(patterns[:, :3].sum(1) > 1, 0.8, 0.1))
    assert ((q[back.ravel()] > 0.5) == y).mean() > 0.95


def test_languages(spark):
    rng = random.Random(2)
    v = {"xx": ["the", "and", "thing", "with"], "yy": ["und", "nicht", "schon", "auch"], "zz": ["ção", "não", "mais", "então"]}
    rows = [(i, words(rng, 40, v[lang]), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    odd = [(500, None, "xx"), (501, "", None), (502, "123 !?", "yy"), (503, words(rng, 60, v["xx"]) + " " + words(rng, 40, v["zz"]), None), (504, "中", None), (505, "the and " * 50_000, None), (None, "und auch nicht", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id LONG, text STRING, lang STRING")
    model = language_id.fit(docs, keep=F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 0)
    assert model.languages == ("xx", "yy", "zz")
    got = {r["doc_id"]: r["language"] for r in language_id.classify(docs, model).collect()}
    assert all(got[i]["lang"] == lang for i, _, lang in rows)
    assert [got[i]["lang"] for i in (500, 501, 502)] == ["und"] * 3 and got[500]["score"] == 0
    mixed = {x["lang"]: x["share"] for x in got[503]["languages"]}
    assert got[503]["lang"] == "xx" and set(mixed) == {"xx", "zz"} and abs(mixed["xx"] - 0.6) < 0.15
    assert got[504]["lang"] in model.languages and got[505]["lang"] == "xx" and got[None]["lang"] == "yy"
    nothing = language_id.fit(docs.where("lang IS NULL"))
    assert {r[0] for r in language_id.classify(docs, nothing).select("language.lang").distinct().collect()} == {"und"}
    assert language_id.classify(docs.limit(0), model).count() == 0


# --- near duplicates


def test_word_hashes_follow_words():
    rng = random.Random(5)
    seen = {}
    for t in ["", "a", "A-a a", "Ünï ünï", *("".join(rng.choice("abé Ü.,1\n") for _ in range(50)) for _ in range(300))]:
        w, h = _common.words(t.encode()), _common.word_hashes(t.encode()).tolist()
        assert len(w) == len(h)
        for a, b in zip(w, h, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("rows", [512, 7])
def test_alignment_equals_the_full_table(monkeypatch, rows):
    monkeypatch.setattr(order_minhash, "ROWS", rows)
    rng = np.random.default_rng(9)
    for _ in range(150):
        kinds = int(rng.integers(3, 60))
        a = rng.integers(0, kinds, rng.integers(1, 70)).astype(np.uint32)
        b = a.tolist()
        for _ in range(rng.integers(0, 8)):
            at, turn = int(rng.integers(0, len(b) + 1)), rng.random()
            b[at : at + (turn < 0.7)] = [int(rng.integers(0, kinds))] * (turn > 0.3)
        b = np.array(b or [1], np.uint32)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        want = t[-1, -1] / (len(a) + len(b) - t[-1, -1])
        assert order_minhash.alignment(a, b, 0.8) == (pytest.approx(want) if want >= 0.8 - 1e-9 else 0.0)


def test_sketch_in_pieces_is_the_same(monkeypatch):
    h = np.random.default_rng(0).integers(1, 1 << 63, 1000).astype(np.uint64)
    seeds = np.arange(1, 41, 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = order_minhash.sketch(h, seeds, 5)
    monkeypatch.setattr(order_minhash, "CHUNK", 64)
    assert (order_minhash.sketch(h, seeds, 5) == whole).all()
    assert (order_minhash.sketch(h[::-1], seeds, 5) != whole).all()


def classes_by_force(texts, threshold=0.8):
    """Components over all pairs by the alignment of their words; equal texts are one."""
    found = [order_minhash.codes(_common.word_hashes(t.encode())) if t is not None else np.zeros(0, np.uint32) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j] or order_minhash.alignment(found[i], found[j], threshold) > 0
            if same and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("edits", [0.02, 0.05, 0.1])
def test_sketches_see_near_copies_of_any_length(edits):
    """Of pairs above the threshold by all-pairs comparison, by length and share of edits, at least 98 in 100 agree in a sketch."""
    rng = np.random.default_rng(int(edits * 100))
    sketches = order_minhash.Sketches(1, 8, 32, 4, 24, 0.8, 23)
    seen = total = 0
    for n in [*range(5, 80), *range(80, 1500, 40)] * 3:
        w = rng.integers(1, 1 << 62, 4 * n).astype(np.uint64)[rng.integers(0, 4 * n, n)]
        kinds = rng.choice(4, n, p=[edits / 4, 1 - edits, edits / 4, edits / 2])
        other = np.array([y for x, k in zip(w.tolist(), kinds, strict=True) for y in ([], [x], [x, x + (1 << 33)], [x + (1 << 34)])[k]], np.uint64)
        if order_minhash.alignment(order_minhash.codes(w), order_minhash.codes(other), 0.8):
            total += 1
            seen += bool(set(sketches.of(w).tolist()) & set(sketches.of(other).tolist()))
    assert total > 150 and seen >= 0.98 * total


def test_recall_on_the_small_tables(spark):
    """All pairs of different texts that reach the threshold, by brute force, are in one class."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    got = dict(zip(docs.doc_id, classes_by_force(docs.text.tolist()), strict=True))
    found = queries.op6_near_duplicates(spark, SMALL).toPandas()
    classes = dict(zip(found.doc_id, found.class_id, strict=True))
    first = dict(zip(range(len(docs)), docs.doc_id, strict=True))
    pairs = [(d, first[c]) for d, c in got.items() if d != first[c]]
    assert len(pairs) > 20 and sum(classes[a] == classes[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert (found.groupby("class_id").doc_id.transform("size") == found.class_size).all()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    v = [f"w{i}" for i in range(3000)]
    passage = words(rng, 60, v)
    texts: list = [None, None, "", "", "!!", "!!", "one two", "One, two!", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = words(rng, rng.randint(60, 200), v).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(v)
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    texts += [words(rng, 15, v) + " " + passage + " " + words(rng, 15, v) for _ in range(60)]
    chain = words(rng, 150, v).split()
    for i in range(60):  # each near the one before, the ends far apart
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"new{i}"
        texts.append(" ".join(chain))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_force(texts)


def test_short_near_copies_are_found(spark):
    """Pairs at the threshold whose long sketches hold nearly all words of a text, or all."""
    rng = random.Random(17)
    v = [f"w{i}" for i in range(2000)]
    texts = []
    for n in [8] * 10 + list(range(4, 70)):
        base, more = words(rng, n, v), words(rng, n // 4, v)  # n / (n + n // 4) is at least 0.8
        texts += [base, f"{more} {base}" if rng.random() < 0.5 else f"{base} {more}"]
    hot = words(rng, 8, v)
    texts += [f"{hot} {x}" for x in v[:150]]  # all near the text without the last word, and only by it
    texts.append(hot)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_force(texts)
    assert all(got[i] == got[i + 1] for i in range(0, 152, 2))


def test_near_duplicates_odd_rows(spark):
    got = sorted(((r["doc_id"], r["class_id"]) for r in order_minhash.near_duplicates(table(spark, ODD)).collect()), key=str)
    assert len(got) == len(ODD) and Counter(got)[(5, 5)] == 2 and (6, 5) in got and (0, 0) in got and (None, None) in got
    assert order_minhash.near_duplicates(table(spark, [])).count() == 0


def test_unsettled_buckets_are_compared(spark):
    """A bucket whose nodes are in components of their own gives the pairs within it that could be near."""
    rng = random.Random(3)
    v = [f"w{i}" for i in range(500)]
    base = words(rng, 80, v).split()
    near = [" ".join(base), " ".join([*base[:-1], "x"]), words(rng, 80, v)]
    known = order_minhash.sketched(table(spark, near), order_minhash.Sketches(1, 8, 32, 4, 24, 0.8, 1), id_col="doc_id", text_col="text")
    by = {r["doc_id"]: r["node"] for r in known.collect()}
    members = known.select(F.lit(7).cast("long").alias("value"), "node", "n")
    none = members.select("node", F.col("node").alias("component")).limit(0)
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in order_minhash.unsettled(members, none, known.select("node", "n", "marks"), 0.8).collect()}
    assert got == {frozenset((bytes(by[0]), bytes(by[1])))}


# --- chat


def test_chat_query_equals_sql(spark):
    got = queries.op8_chat(spark, SMALL).toPandas()
    assert differences(got, connect(SMALL).sql(chat.ORACLE_SQL).df()) == ""


def test_chat_edge_cases(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", "hi"), (4, 1, "bot", "y"), (4, 1, "bot", "y"),
        (5, 0, None, None), (6, None, "user", "first"), (6, 0, "user", "then<|im_end|>"), (None, 0, "user", "hi"), (None, 0, "user", "alone"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, rendered STRING")
    got = {(r["conv_id"], r["rendered"]): (r["n_turns"], r["n_copies"]) for r in chat.maximal_conversations(df).collect()}
    o, c = chat.OPEN, chat.CLOSE
    assert got == {
        (2, f"{o}user\nhi{c}\n{o}bot\nyo{c}\n"): (2, 2), (4, f"{o}user\nhi{c}\n{o}bot\ny{c}\n"): (2, 1), (5, f"{o}unknown\n{c}\n"): (1, 1),
        (6, f"{o}user\nfirst{c}\n{o}user\nthen< |im_end|>{c}\n"): (2, 1), (None, f"{o}user\nalone{c}\n"): (1, 1),
    }
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    plan = queries.op8_chat(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- packing


def test_tokens_equal_the_tokenizers_own():
    e = packing.encoder(queries.tokenizer_path())
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Zé.,!?'\n\t  　1中st-<|endoftext|>") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "", " ", "  ", "a ", " a", "it's  don't", "<|endoftext|> x", "\n\n a\n b \n", LONG_TEXT[:5000]]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    for got, t in zip(e.encode(texts), texts, strict=True):
        assert got == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_first_fit_decreasing_equals_the_plain_rule():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        where, offset = packing.first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for s, w, o in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [100] * (k == len(room))
            assert (w, o) == (k, 100 - room[k])
            room[k] -= s


def test_packing(spark):
    docs = table(spark, [*ODD, *(f"text {i} " * (i % 90) for i in range(400))])
    pieces = packing.token_pieces(docs, queries.tokenizer_path(), group_docs=100)
    packed = packing.assign_sequences(packing.with_digest(pieces))
    p = packed.toPandas().sort_values(["sequence_id", "offset"])
    assert (p["offset"] == p.groupby("sequence_id")["length"].cumsum() - p["length"]).all()
    total = p.groupby("sequence_id")["length"].transform("sum")
    assert (total == p["sequence_tokens"]).all() and total.max() <= 1024
    assert (p["padded_tokens"] == total.map(lambda n: n if n & (n - 1) == 0 else 1024)).all()
    e = packing.encoder(queries.tokenizer_path())
    want = sum(len(e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert p["length"].sum() == want
    assert sum(len(r["ids"]) // 4 for r in packing.sequences(pieces, packed).collect()) == want
    empty = p[(p["doc_id"] == 1)]
    assert empty[["start", "length", "doc_tokens"]].to_numpy().tolist() == [[0, 1, 1]] and empty["ids_crc32"].item() == zlib.crc32(bytes(4))
    assert packing.token_pieces(docs.limit(0), queries.tokenizer_path()).count() == 0


# --- language model


def test_masked_lm_learns(spark):
    rng = random.Random(8)
    pairs = [(f"left{i}", f"right{i}") for i in range(30)]
    texts = [" ".join(f"{a} {b}" for a, b in (rng.choice(pairs) for _ in range(60))) for _ in range(120)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:20]]
    docs = masked_lm.with_ids(table(spark, texts + shuffled + ODD)).repartition(2)
    known = _common.stored(docs, "lm-test")
    model = masked_lm.fit(known.where(F.col("doc_id") < 120), rounds=2)
    got = {(r["doc_id"], r["text"]): r["lm"] for r in masked_lm.score(known, model).collect()}
    ordered = np.mean([got[(i, t)]["mean_log_likelihood"] for i, t in enumerate(texts[:20])])
    mixed = np.mean([got[(120 + i, t)]["mean_log_likelihood"] for i, t in enumerate(shuffled)])
    start = np.mean([masked_lm.log_likelihood(masked_lm.Model(model.vocabulary, masked_lm.random_start(31)), model.vocabulary.ids(masked_lm.word_ids(t.encode()).tobytes())) / 120 for t in texts[:20]])
    assert ordered > mixed + 0.5 and ordered > start + 0.5
    assert got[(140, None)] == got[(141, "")] == (0, 0.0, None)
    assert got[(145, "same text twice")] == got[(146, "same text twice")]
    assert masked_lm.score(known.limit(0), masked_lm.fit(known.limit(0))).count() == 0


def test_every_place_of_copies_is_learned(spark):
    text = " ".join(f"w{i}" for i in range(24))
    known = _common.stored(masked_lm.with_ids(table(spark, [text] * 2000)).repartition(2), "lm-copies")
    scored = masked_lm.score(known.limit(1), masked_lm.fit(known)).first()["lm"]
    assert scored["mean_log_likelihood"] > -1


def test_long_texts_are_scored_in_stretches(monkeypatch):
    model = masked_lm.Model(masked_lm.vocabulary(np.arange(1 << 16, dtype=float)), masked_lm.random_start(0))
    w = model.vocabulary.ids(masked_lm.word_ids(b" ".join(b"w%d" % (i % 77) for i in range(1000))).tobytes())
    whole = masked_lm.log_likelihood(model, w)
    monkeypatch.setattr(masked_lm, "STRETCH", 64)
    assert masked_lm.log_likelihood(model, w) == pytest.approx(whole, rel=1e-6)


def test_marks_bound_what_two_texts_share():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200, 60_000):  # the last fills classes
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.union1d(a[: len(a) // 2], rng.integers(0, 1 << 62, n).astype(np.uint64))
        x, y = (np.frombuffer(order_minhash.marks(h), np.uint64)[None, :] for h in (a, b))
        bound, shared = order_minhash.most_shared(x, y, np.array([len(a)]), np.array([len(b)]))[0], len(np.intersect1d(a, b))
        assert shared <= bound <= min(len(a), len(b))
        assert n > 200 or bound <= shared + 0.2 * n  # texts of usual length are told apart


# --- plain versions of what is learned


def test_masked_lm_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    voc = masked_lm.vocabulary(rng.integers(0, 50, 1 << 16).astype(float))
    net = [x + rng.normal(0, 0.3, x.shape).astype(np.float32) for x in masked_lm.random_start(5)]
    w = rng.integers(0, 1 << 16, 9).astype(np.uint32)
    rows, total = [0, 0, *voc.inputs[w].tolist(), 0, 0], 0.0
    for i, x in enumerate(w):
        h = np.tanh(sum(net[0][k][rows[i + d]] for k, d in enumerate((0, 1, 3, 4))).astype(float) + net[1])
        z = h @ net[2] + net[3]
        total += z[voc.classes[x]] - np.log(np.exp(z).sum()) + voc.within[x]
    assert masked_lm.log_likelihood(masked_lm.Model(voc, net), w) == pytest.approx(total, rel=1e-4)
    shares = np.bincount(voc.classes, np.exp(voc.within), masked_lm.CLASSES)
    assert shares == pytest.approx(np.ones(masked_lm.CLASSES), rel=1e-3)  # each class is a distribution


def test_urls_score_like_plain_markov_models(spark):
    good, bad = ["http://a.org/x", "http://b.org/yy"], ["http://c.com/q1", "http://d.com/q2"]
    rows = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad], "url STRING, verdict STRING")
    model = url_filter.fit(rows)

    def plain(urls, url):
        counts = [Counter() for _ in range(url_filter.ORDER + 1)]

        def symbols(u):
            return [0] * url_filter.ORDER + [int(url_filter._TABLE[b]) for b in u.encode()] + [0]

        for u in urls:
            s = symbols(u)
            for i in range(url_filter.ORDER, len(s)):
                for k in range(url_filter.ORDER + 1):
                    counts[k][tuple(s[i - k : i]), s[i]] += 1

        def p(k, context, x):
            if k < 0:
                return 1 / url_filter.ALPHABET
            below, here = p(k - 1, context[1:], x), {y: n for (c, y), n in counts[k].items() if c == context}
            n, kinds = sum(here.values()), len(here)
            return (here.get(x, 0) + kinds * below) / (n + kinds) if n else below

        s = symbols(url)
        at = range(url_filter.ORDER, len(s))
        return sum(np.log(p(url_filter.ORDER, tuple(s[i - url_filter.ORDER : i]), s[i])) for i in at) / len(at)

    for url in ("http://a.org/q", "http://zz.net/", "x"):
        assert url_filter.score(model, url) == pytest.approx(plain(good, url) - plain(bad, url), abs=1e-5)


def test_quality_ridge_equals_the_plain_solution(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(5, 60), ["alpha", "beta.", "GAMMA!!", "delta"] if i % 3 else ["x", "1", "##"]) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id LONG, quality INT")
    model = quality.fit(table(spark, texts), labels, features=32)
    parts = {r["_label_id"]: r["_part"] for r in _common.labelled_sample(labels, "doc_id", "quality", F.lit(True), 6000)[0].collect()}
    fitted = [i for i in range(240) if parts[i]]
    x, y = np.array([quality.statistics(texts[i]) for i in fitted]), np.array([i % 3 > 0 for i in fitted], float)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.maximum(1e-6, x.std(0)))
    z, c = quality.fourier(x, model), np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))[:, None]
    theta = np.linalg.solve(z.T @ (z * c) + 1e-3 * len(y) * np.eye(z.shape[1]), z.T @ (y[:, None] * c))[:, 0]
    assert z @ model.theta == pytest.approx(z @ theta, abs=1e-6)


def test_language_shares_equal_a_plain_mixture():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(50), 3).T
    c = rng.multinomial(400, p @ [0.6, 0.4, 0.0]).astype(float)
    share = np.full(3, 1 / 3)
    for _ in range(3000):  # responsibilities one cell at a time
        gain = np.zeros(3)
        for g in range(50):
            r = share * p[g]
            gain += c[g] * r / r.sum()
        share = gain / gain.sum()
    got, _ = language_id._em(p, c, np.full(3, 1 / 3), 3000)
    assert got == pytest.approx(share, abs=0.02)


def test_a_full_sample_of_labels_calibrates_like_all_labels(spark):
    """A bound on the rows of a class doesn't move the scores' mean towards one half."""
    rng = random.Random(6)
    good, bad = ["alpha", "beta", "gamma", "delta."], ["x1", "##", "zz!!", "alpha"]
    texts = [words(rng, 40, good if rng.random() < (0.9 if i % 10 else 0.3) else bad) for i in range(2000)]
    docs, labels = table(spark, texts), spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(2000)], "doc_id LONG, quality INT")
    means = [quality.score(docs, quality.fit(docs, labels, features=32, rows_per_class=n), out="s").agg(F.avg("s")).first()[0] for n in (150, 6000)]
    assert means[0] == pytest.approx(means[1], abs=0.05) and means[1] == pytest.approx(0.9, abs=0.05)


# --- contracts of the queries, and names that clash


CONTRACTS = {
    "op1_transport_stream": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_toxicity": "doc_id held_out score predicted",
    "op4_url_filter": "page_id host path rule verdict",
    "op5_quality": "doc_id held_out score predicted",
    "op6_near_duplicates": "doc_id class_id",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_masked_lm": "doc_id log_likelihood",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_return_what_is_asked(spark, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    assert list(got.columns)[: len(CONTRACTS[name].split())] == CONTRACTS[name].split() or set(CONTRACTS[name].split()) <= set(got.columns)
    key = "page_id" if "page_id" in got else "doc_id"
    ids = spark.read.parquet(f"{SMALL}/{'pages' if key == 'page_id' else 'documents'}.parquet").toPandas()[key]
    assert set(got[key]) == set(ids) and (name == "op9_packing" or len(got) == len(ids))
    if "score" in got:
        assert got.score.between(0, 1).all()
    for column, modulus, held in (("op2", 4, 2), ("op5", 5, 0), ("op7", 3, 1)):
        if name.startswith(column):
            assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % modulus == held for i in got[key]]
    if "predicted" in got:
        assert (got.predicted == (got.score >= 0.3)).all()
    if name == "op9_packing":
        assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024


def test_outputs_replace_columns_of_their_name(spark):
    docs = table(spark, ["the one and the other", None]).withColumn("out", F.lit(1))
    labels = spark.createDataFrame([(0, 1)], "doc_id LONG, toxic INT").withColumn("quality", F.lit(1))
    bench = spark.createDataFrame([(1, "the one")], "item_id LONG, text STRING")
    found = [
        toxicity.score(docs, toxicity.fit(docs, labels), out="out"), quality.score(docs, quality.fit(docs, labels), out="OUT"), decontaminate.decontaminate(docs, bench, out="out"),
        language_id.classify(docs, language_id.fit(docs), out="out"), url_filter.with_score(docs, url_filter.Model(None), url_col="text", out="out"), masked_lm.with_ids(docs, out="out"), transport_stream.mux_column(docs.withColumn("b", F.col("text").cast("binary")), "b", out="out"),
    ]
    for df in found:
        assert [c.lower() for c in df.columns].count("out") == 1 and df.count() == 2 and df.columns[-1].lower() == "out"


def test_blocks_join_what_pairs_join(spark, monkeypatch):
    """Verification in blocks gives the components of pairwise verification."""
    monkeypatch.setattr(order_minhash, "BLOCK", 4)
    rng = random.Random(9)
    v = [f"w{i}" for i in range(300)]
    base = words(rng, 60, v).split()
    texts = []
    for i in range(24):
        other = list(base if i % 2 else base[::-1])
        for _ in range(i % 5 + 2):
            other[rng.randrange(60)] = rng.choice(v)
        texts.append(" ".join(other))
    docs = table(spark, texts)
    nodes = order_minhash.sketched(docs, order_minhash.Sketches(1, 8, 32, 4, 24, 0.8, 1), id_col="doc_id", text_col="text").select("node")
    known = order_minhash.node_words(docs, nodes, text_col="text")
    pairs = nodes.select(F.col("node").alias("a")).join(nodes.select(F.col("node").alias("b")), F.col("a") < F.col("b"))

    def classes(links):
        groups = {}
        for r in order_minhash.components(links.select("a", "b")).collect():
            groups.setdefault(bytes(r["component"]), set()).add(bytes(r["node"]))
        return sorted(map(sorted, groups.values()))

    assert classes(order_minhash.verified_in_blocks(known, pairs, threshold=0.8)) == classes(order_minhash.verified(known, pairs, threshold=0.8)) != []
