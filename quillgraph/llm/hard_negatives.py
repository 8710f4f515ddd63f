"""Hard negatives: inner products bounded by an orthogonal rotation onto principal components, verified by integer products.

Components become integers ``floor(scale * x)``. The rotation keeps inner products and puts most of their weight first, so the
product of the leading components, plus or minus the product of the residual norms and a slack for rounding, bounds a score
from both sides. A pair goes as soon as its bound can't reach what it would have to beat (``steps`` of leading components);
survivors get the exact integer product. The rotation comes from the second moments of at most ``sample_rows`` rows (those
with the least hashes); it has no effect on results, only on how many pairs go early.

Anchors are a stated query set and taken in blocks of about ``block_anchors``; a block is broadcast and every task scans its rows
once for positives and once for negatives, keeping the best few per anchor. So no label or vector makes a hot task, and only
the best few of each task are shuffled.

Edge cases: rows with a null label, a null vector, null or non-finite components, or another length than that of the row with the smallest id,
take no part; a null id can't be an anchor and comes last on ties; repeated rows are rows of their own (an anchor isn't its own positive,
its copy is) and repeated anchors have results each; an empty table gives no rows; extra columns are ignored. Components are cut
at a bound so that a hundred times a score fits into a long (2^24 at 64 components: |x| up to 65,536 at scale 256).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, give_back, shared_dir, stored
from .vector_codes import usable

#: Rows compared with a block of anchors at a time.
ROWS = 1024
LAST = np.iinfo(np.int64).max


def integers(vectors: pa.Array, size: int, scale: int) -> np.ndarray:
    limit = 2.0 ** ((54 - (size - 1).bit_length()) // 2)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -limit, limit).reshape(-1, size)


def rotation(rows: DataFrame, size: int, scale: int, sample_rows: int) -> np.ndarray:
    """Orthogonal; its columns are the eigenvectors of the second moments, the largest first."""
    some = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("vector").toArrow().column(0).combine_chunks()
    x = integers(some, size, scale) / scale
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])


class Side:
    """Integer vectors, their rotation, and the norm of what comes after each step of leading components."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, steps: list[int]) -> None:
        self.exact = x.astype(np.int64)
        self.turned = x @ turn
        square = self.turned**2
        self.rest = [np.sqrt(square[:, k:].sum(1)) for k in steps]
        self.norm = np.sqrt(square.sum(1))


def survivors(x: Side, a: Side, steps: list[int], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, exact score) of the wanted pairs whose score may lie between an anchor's ``low`` and ``high``."""
    k = steps[0]
    part = x.turned[:, :k] @ a.turned[:, :k].T
    room = x.rest[0][:, None] * a.rest[0][None] + 1e-9 * (1 + x.norm[:, None] * a.norm[None])
    i, j = np.nonzero(wanted & (part + room >= low[None]) & (part - room <= high[None]))
    part = part[i, j]
    for s, (k, past) in enumerate(zip(steps, steps[1:], strict=False), 1):
        part = part + np.einsum("ij,ij->i", x.turned[i, k:past], a.turned[j, k:past])
        room = x.rest[s][i] * a.rest[s][j] + 1e-9 * (1 + x.norm[i] * a.norm[j])
        keep = (part + room >= low[j]) & (part - room <= high[j])
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, np.einsum("ij,ij->i", x.exact[i], a.exact[j])


class Best:
    """The best ``most`` (score, id) of each of ``n`` lists: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.least = most, np.full(n, -np.inf)
        self.list, self.score, self.id, self.absent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        if not len(which):
            return
        c = [np.concatenate(x) for x in ((self.list, which), (self.score, score), (self.id, ids), (self.absent, absent))]
        order = np.lexsort((c[2], c[3], -c[1], c[0]))
        c = [x[order] for x in c]
        first = np.flatnonzero(np.concatenate([[True], c[0][1:] != c[0][:-1]]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
        self.list, self.score, self.id, self.absent = (x[rank < self.most] for x in c)
        full = rank == self.most - 1
        self.least[c[0][full]] = c[1][full]


def mine(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, steps: tuple[int, ...] = (16, 32), block_anchors: int = 2048, sample_rows: int = 20_000,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first ``positives`` rows of its
    label, the first ``negatives`` rows of another label with ``low_percent`` to ``high_percent`` hundredths of the positive's score.

    ``anchors`` is a condition on the columns of ``vectors``. Scores are integer inner products; higher first, then the smaller id.
    """
    spark = vectors.sparkSession
    is_anchor = F.coalesce(anchors & F.col(id_col).isNotNull(), F.lit(False))
    rows = vectors.where(usable(vector_col) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), is_anchor.alias("anchor"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    head = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).select(F.size("vector")).collect()
    size = head[0][0] if head else 0
    result = "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG"
    if not size:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vector") == size)
    turn = rotation(rows, size, scale, sample_rows)
    cuts = [k for k in steps if k < size] or [size]
    blocks = max(1, -(-rows.where("anchor").count() // block_anchors))
    bounded_batches(spark)

    def scan(shared, keep: int, lists: int, choose) -> DataFrame:
        """The best of each task for each list of the anchors in ``shared``; ``choose(best, side, a, batch)`` adds what a batch has."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = shared.value
            a, best = Side(told["x"], told["turn"], cuts), Best(len(told["x"]) * lists, keep)
            for b in batches:
                ids = b.column(0).fill_null(LAST).to_numpy()
                absent = b.column(0).is_null().to_numpy(zero_copy_only=False)
                labels, number = b.column(1).to_numpy(), b.column(3).to_numpy()
                x = integers(b.column(2), size, scale)
                for at in range(0, len(x), ROWS):
                    s = slice(at, at + ROWS)
                    choose(best, Side(x[s], told["turn"], cuts), a, told, ids[s], absent[s], labels[s], number[s])
            yield pa.RecordBatch.from_arrays([pa.array(best.list), pa.array(best.score), pa.array(best.id, mask=best.absent)], names=["list", "score", "id"])
            give_back()

        found = rows.select("id", "label", "vector", "row").mapInArrow(run, "list LONG, score LONG, id LONG")
        order = Window.partitionBy("list").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    def choose_positive(best, x, a, told, ids, absent, labels, number) -> None:
        wanted = (labels[:, None] == told["label"][None]) & (number[:, None] != told["row"][None])
        i, j, score = survivors(x, a, cuts, wanted, best.least, np.full(len(told["row"]), np.inf))
        best.add(j, score, ids[i], absent[i])

    def choose_negative(best, x, a, told, ids, absent, labels, number) -> None:
        score = told["score"]  # of the positives, one row an anchor, 0 where there is none
        n, most = score.shape
        floor = np.where(told["have"], np.maximum(best.least.reshape(n, most), np.where(told["have"], low_percent * score / 100 - 1, 0)), np.inf)
        ceiling = np.where(told["have"], high_percent * score / 100 + 1, -np.inf)
        i, j, found = survivors(x, a, cuts, labels[:, None] != told["label"][None], floor.min(1), ceiling.max(1))
        for p in range(most):
            fits = told["have"][j, p] & (low_percent * score[j, p] <= 100 * found) & (100 * found <= high_percent * score[j, p])
            best.add(j[fits] * most + p, found[fits], ids[i[fits]], absent[i[fits]])

    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for k in range(blocks):
        block = rows.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).select("row", "id", "label", "vector").toArrow()
        n = block.num_rows
        x = integers(block.column(3).combine_chunks(), size, scale) if n else np.zeros((0, size))
        told = {"x": x, "turn": turn, "row": block.column(0).to_numpy(), "label": block.column(2).to_numpy()}
        first = scan(spark.sparkContext.broadcast(told), positives, 1, choose_positive).toArrow()  # at most ``positives`` rows an anchor of the block
        score, have, names = np.zeros((n, positives), np.int64), np.zeros((n, positives), bool), np.zeros((n, positives), np.int64)
        at = first.column(0).to_numpy(), first.column(3).to_numpy() - 1
        score[at], have[at], names[at] = first.column(1).to_numpy(), True, first.column(2).fill_null(LAST).to_numpy()
        absent = np.zeros((n, positives), bool)
        absent[at] = first.column(2).is_null().to_numpy()
        told |= {"score": score, "have": have}
        chosen = scan(spark.sparkContext.broadcast(told), negatives, positives, choose_negative)
        # the block's anchors and positives, by the number of their list
        lists = pa.table({"list": pa.array(np.arange(n * positives)), "anchor_id": np.repeat(block.column(1).to_numpy(), positives), "positive_id": pa.array(names.ravel(), mask=absent.ravel()), "positive_score": score.ravel()})
        named = chosen.join(F.broadcast(spark.createDataFrame(lists)), "list")
        named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)


ORACLE_SQL = r"""
WITH row AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pair AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM row a JOIN row b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
