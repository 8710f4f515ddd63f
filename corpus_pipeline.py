"""The corpus pipeline: language ID, toxicity, near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir), decides about all documents that its predecessor kept, and returns those it keeps, in
the columns of ``documents``; the last returns packed pieces. A rejected document goes: one in no learned language (stage 1),
one predicted toxic (stage 2), every copy but the one that names its class (stage 3), one with a benchmark window (stage 4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate as leaks
from quillgraph.llm import language_id, order_minhash, packing, queries, toxicity
from quillgraph.llm._common import free_name, residue, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a learned language that fits better than chance; ``und`` goes."""
    model = language_id.fit(docs, keep=residue("doc_id", 3) != 1)
    name = free_name(docs, "language")
    found = language_id.classify(docs, model, out=name)
    return found.where((F.col(name)["lang"] != language_id.UNKNOWN) & (F.col(name)["fit"] > 0)).drop(name)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3."""
    model = queries.fit_toxicity(docs, queries.read(spark, sf_dir, "labels", "doc_id", "toxic"))
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, model, out=name).where(F.col(name)["score"] < 0.3).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, of equal ids the one with the smaller digest.

    A row is told from others by id and text, so rows that share an id but not a text are judged each by itself; of rows equal
    in both one stays. A document without id stays only where no other of its class has one. Any row can have any length.
    """
    row, text = free_name(docs, "row_key"), F.col("text")
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.md5(text).alias("digest"))
    keyed = docs.withColumn(row, key)
    classes = order_minhash.near_duplicates(keyed.select(row, "text"), id_col=row)
    gone = classes.where("doc_id.absent <> class_id.absent OR NOT doc_id.id <=> class_id.id OR NOT doc_id.digest <=> class_id.digest").select("doc_id.id", "doc_id.digest").distinct()
    kept = keyed.join(gone, F.col(row)["id"].eqNullSafe(gone["id"]) & F.col(row)["digest"].eqNullSafe(gone["digest"]), "left_anti")
    return kept.dropDuplicates([row]).select(*docs.columns)


def keep_clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    name = free_name(docs, "leaks")
    found = leaks.decontaminate(docs, queries.read(spark, sf_dir, "benchmark", "item_id", "text"), out=name)
    return found.where(F.size(F.col(name)["items"]) == 0).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids."""
    return packing.assign_sequences(packing.with_digest(packing.token_pieces(docs, queries.tokenizer_path())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("toxicity", keep_civil),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", keep_clean_of_benchmarks),
    ("packing", pack),
]

#: SQL can't express the stages (trained models, tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
