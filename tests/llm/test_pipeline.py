"""The corpus pipeline against the stages' own verdicts, and on odd rows."""

import random

import corpus_pipeline
from conftest import SMALL
from pyspark.sql import functions as F
from quillgraph.llm import decontaminate
from quillgraph.llm._common import stored

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        out.append(docs)
    return out


def test_stages_on_the_small_tables(spark):
    start, lang, civil, one, clean, packed = stages(spark, SMALL)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "decontaminate", "packing"]
    for df in (lang, civil, one, clean):
        assert df.columns == start.columns
    counts = [df.count() for df in (start, lang, civil, one, clean)]
    assert counts == sorted(counts, reverse=True) and counts[3] < counts[2] and counts[4] < counts[3]
    assert one.select("text").distinct().count() == one.count()
    items = [t for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for t in decontaminate.windows(r["text"].encode(), 10)]
    known = set(items)

    def leaks(text):
        w = decontaminate.words(text.encode())
        return any(tuple(w[i : i + n]) in known for n in {len(x) for x in known} for i in range(len(w) - n + 1))

    kept = {r["doc_id"] for r in clean.collect()}
    assert {r["doc_id"] for r in one.collect() if not leaks(r["text"])} == kept
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    v = {"en": ["the", "and", "thing", "with", "house"], "de": ["und", "nicht", "schon", "auch", "Haus"]}
    rows = [(i, " ".join(rng.choice(v[lang]) for _ in range(50)), lang, "s", None) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [(100, None, "en", None, 0), (101, "", "en", "s", 0), (102, "12 34", None, "s", 1), (103, rows[0][1], "en", "s", 1), (0, rows[0][1], "en", "s", None), (None, "the and thing with the house", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").withColumn("toxicity", F.lit("clash"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[1][1].split()[:12]))], "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    start, lang, civil, one, clean, packed = stages(spark, folder)
    gone = {100, 101, 102}
    assert {r["doc_id"] for r in lang.collect()} == {r[0] for r in rows} - gone and civil.count() == lang.count()
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) and 103 not in ids and 0 in ids and None in ids
    assert 1 not in {r["doc_id"] for r in clean.collect()} and clean.columns == docs.columns
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_an_id_on_two_texts_loses_neither(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, b), (5, a), (5, b), (7, c), (7, c), (None, a), (None, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert sorted(kept) == [(2, b), (5, a), (7, c)]
