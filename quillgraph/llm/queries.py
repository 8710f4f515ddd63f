"""The queries of the training-data operators, each over its whole table, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hard_negatives, language_id, masked_lm, order_minhash, packing, quality, substring_dedup, toxicity, transport_stream, url_filter, vector_codes
from ._common import residue, stored

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
TOKENIZER = "byte_bpe_50k.json"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text, padded with blanks to a multiple of 192 bytes, muxed to a transport stream and read back from it."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit(""))
    n = F.octet_length(raw).cast("long")
    padded = F.concat(raw.cast("binary"), F.repeat(F.lit(" "), (F.greatest(F.lit(192), F.ceil(n / 192) * 192) - n).cast("int")).cast("binary"))
    rows = transport_stream.mux_column(docs.select("doc_id", n.alias("n_bytes"), padded.alias("payload")), "payload").drop("payload")
    rows = transport_stream.demux_column(rows, "media")
    data, d = F.col("demuxed.streams")[0]["payload"], F.col("demuxed")
    units = d["streams"][0]["units"]
    points = F.array_join(F.transform(F.filter(units, lambda u: u["random_access"]), lambda u: F.concat_ws("@", u["pts"].cast("string"), u["offset"].cast("string"))), ",")
    feature = F.concat_ws(
        ";",
        F.format_string("packets=%d", d["packets"]), F.format_string("bad=%d", d["bad_packets"]), F.format_string("gaps=%d", d["continuity_errors"]), F.format_string("pcr=%d", d["clock_references"]),
        F.format_string("program=%d", d["programs"][0]["program"]), F.format_string("pid=%d", d["streams"][0]["pid"]), F.format_string("type=%d", d["streams"][0]["stream_type"]),
        F.format_string("units=%d", F.size(units)), F.format_string("last_pts=%d", F.element_at(units, -1)["pts"]), F.concat(F.lit("random_access="), points),
    )
    return rows.select(
        "doc_id", "n_bytes", F.octet_length(data).cast("long").alias("payload_bytes"), F.sha2(data, 256).alias("payload_sha256"),
        F.crc32(F.substring(data, -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, keep=residue("doc_id", 4) != 2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic")
    scored = toxicity.score(docs, fit_toxicity(docs, labels), out="t")
    s = F.col("t.score")
    return scored.select("doc_id", (residue("doc_id", 4) == 2).alias("held_out"), s.alias("score"), (s >= 0.3).cast("int").alias("predicted"), F.col("t.posterior").alias("posterior"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.decontaminate(docs, items, out="leaks")
    hit = F.aggregate("leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return found.select(
        "doc_id", F.col("leaks.n_words").alias("n_words"), hit.alias("n_hit"), F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages", "page_id", "url"), RULES).drop("url")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")
    scored = quality.score(docs, quality.fit(docs, labels, keep=residue("doc_id", 5) != 0), out="score")
    return scored.select("doc_id", (residue("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs, keep=residue("doc_id", 3) != 1)
    found = language_id.classify(docs.select("doc_id", "text"), model, out="l")
    return found.select("doc_id", (residue("doc_id", 3) == 1).alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.size("l.languages").alias("n_languages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign_sequences(packing.with_digest(packing.token_pieces(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())))


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(masked_lm.with_ids(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "word_ids"), "lm-ids")
    return masked_lm.score(docs, masked_lm.fit(docs), out="lm").select("doc_id", "lm.n_words", "lm.log_likelihood", "lm.mean_log_likelihood")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    coded = stored(vector_codes.encode(vectors, books, out="coded").select("vec_id", "label", "coded.code", "coded.error"), "codes")
    return vector_codes.with_label_error(coded).drop("label").withColumn("codebooks_sha256", F.lit(books.digest()))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP3_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND "text" IS NOT NULL
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), runs AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT r, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM windows) s)
), found AS (
  SELECT r, i, runs.size, item FROM runs JOIN windows ON runs.size = windows.size AND runs.run = windows.run
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_transport_stream, op2_toxicity, op3_decontaminate, op4_url_filter, op5_quality, op6_near_duplicates, op7_language_id, op8_chat, op9_packing, op10_masked_lm, op11_substring_dedup, op12_vector_codes, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op8_chat": chat.ORACLE_SQL, "op11_substring_dedup": substring_dedup.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
