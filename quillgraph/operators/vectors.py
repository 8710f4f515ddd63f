"""Embedding analytics: centroids, cluster statistics and links, outliers, drift, search, map tiles.

Vectors are arrays of unit length with a cluster label. Dot products of two columns are higher-order functions; searches of a
query set take it in bounded blocks as a matrix and keep the best ``k`` of each task before the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def centroids(vectors: DataFrame, *, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, size, centroid): mean vectors; coordinates are averaged as rows, so the map side combines them."""
    cells = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "v"))
    means = cells.groupBy("label", "i").agg(F.avg("v").alias("v"), F.count("*").alias("size"))
    out = means.groupBy("label").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    return out.select("label", "size", F.transform("c", lambda x: F.round(x["v"], 9)).alias("centroid"))


def representatives(vectors: DataFrame, cents: DataFrame, top: int = 4, *, id_col: str = "vec_id") -> DataFrame:
    """(label, id, similarity, rank): the members nearest to their centroid."""
    s = F.round(cosine(F.col("embedding"), F.col("centroid")), 6)
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), id_col)
    near = vectors.join(F.broadcast(cents), "label").select("label", id_col, s.alias("similarity"))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def cluster_links(cents: DataFrame, top: int = 3) -> DataFrame:
    """(a, b, similarity): of each cluster the ``top`` most similar ones, each pair once, a < b. The number of clusters is small.

    Half of the similarity is the cosine of the centroids, half the mean similarity of all pairs of members, which for unit
    vectors is the dot product of the mean vectors.
    """
    x, y = cents.select(F.col("label").alias("a"), F.col("centroid").alias("ca")), cents.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    score = 0.5 * cosine(F.col("ca"), F.col("cb")) + 0.5 * dot(F.col("ca"), F.col("cb"))
    pairs = x.join(y, F.col("a") != F.col("b")).select("a", "b", F.round(score, 4).alias("similarity"))
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    best = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


def outliers(vectors: DataFrame, cents: DataFrame, *, id_col: str = "vec_id", far: float = 2.5, astray: float = 1.5) -> DataFrame:
    """(id, label, score, nearest, misplaced, flag): robust z of the distance to the own centroid, and whether another one is nearer.

    Flagged: z over ``far``, or another centroid nearer and z over ``astray``.
    """
    table = F.broadcast(cents.select(F.collect_list(F.struct("label", "centroid")).over(Window.partitionBy(F.lit(1))).alias("all")).limit(1))
    sims = F.transform("all", lambda c: F.struct(c["label"].alias("label"), F.round(cosine(F.col("embedding"), c["centroid"]), 9).alias("s")))
    v = vectors.join(table).select(id_col, "label", sims.alias("sims"))
    own = F.element_at(F.filter("sims", lambda x: x["label"] == F.col("label")), 1)["s"]
    best = F.array_max(F.transform(F.filter("sims", lambda x: x["label"] != F.col("label")), lambda x: F.struct(x["s"].alias("s"), (-x["label"]).alias("minus"))))
    v = v.select(id_col, "label", own.alias("own"), best.alias("best")).withColumn("d", F.round(1 - F.col("own"), 9))
    mid = v.groupBy("label").agg(F.median("d").alias("mid"))
    v = v.join(F.broadcast(mid), "label")
    mad = v.groupBy("label").agg(F.median(F.abs(F.col("d") - F.col("mid"))).alias("mad"))
    scale = F.when(F.col("mad") * 1.4826 > 0, F.col("mad") * 1.4826).otherwise(1e-6)
    z = (F.col("d") - F.col("mid")) / scale
    misplaced = F.coalesce((F.col("best.s") > F.col("own")), F.lit(False))
    out = v.join(F.broadcast(mad), "label").withColumns({"z": z, "misplaced": misplaced.cast("int")})
    flag = ((F.col("z") > far) | ((F.col("misplaced") == 1) & (F.col("z") > astray))).cast("int")
    return out.select(id_col, "label", F.round("z", 3).alias("score"), (-F.col("best.minus")).alias("nearest"), "misplaced", flag.alias("flag"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", block: int = 4096) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest vectors of each query, itself aside, by cosine; exact.

    Queries are taken in blocks of at most ``block``; each task keeps k candidates a query.
    """
    q = queries.select(F.col(id_col).alias("q"), F.col("embedding").alias("v"))
    blocks = max(1, -(-q.count() // block))
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        ids = part.column(0).to_numpy()
        m = np.array(part.column(1).to_pylist(), np.float64)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(ids) else np.zeros((0, 1))
        shared = vectors.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, matrix = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches if len(own) else ():
                got = batch.column(0).to_numpy(zero_copy_only=False)
                v = np.array(batch.column(1).to_pylist(), np.float64)
                s = np.round(matrix @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, 6)
                s[own[:, None] == got[None, :]] = -np.inf
                held = np.broadcast_to(got, s.shape)
                if best:
                    s, held = np.hstack([best[0][0], s]), np.hstack([best[0][1], held])
                order = np.lexsort((held, -s), axis=1)[:, :k]
                best = [(np.take_along_axis(s, order, 1), np.take_along_axis(held, order, 1))]
            for s, held in best:
                keep = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(own[:, None], s.shape)[keep]), pa.array(held[keep]), pa.array(s[keep])], names=["query_id", "id", "similarity"])

        got = vectors.select(id_col, "embedding").mapInArrow(run, "query_id LONG, id LONG, similarity DOUBLE")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tiles(points: DataFrame, cell: float = 8.0) -> DataFrame:
    """(grid_key, x, y, count, dominant, avg_unit, min_unit, max_unit) of points (x, y, label, unit); of equally frequent labels the smallest dominates."""
    keyed = points.withColumn("grid_key", F.concat_ws("_", F.floor(F.col("x") / cell).cast("string"), F.floor(F.col("y") / cell).cast("string")))
    per = keyed.groupBy("grid_key", "label").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("unit").alias("su"), F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    out = per.groupBy("grid_key").agg(F.sum("n").alias("count"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("su").alias("su"), F.min("lo").alias("min_unit"), F.max("hi").alias("max_unit"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("dominant"))
    return out.select("grid_key", F.round(F.col("sx") / F.col("count"), 6).alias("x"), F.round(F.col("sy") / F.col("count"), 6).alias("y"), "count", "dominant", F.floor(F.col("su") / F.col("count") + 0.5).alias("avg_unit"), "min_unit", "max_unit")


def box(points: DataFrame, x: tuple[float, float], y: tuple[float, float], limit: int = 5000) -> DataFrame:
    """Points in a box by id, one more than the limit, which tells that more exist."""
    return points.where(F.col("x").between(*x) & F.col("y").between(*y)).orderBy("id").limit(min(limit, 5000) + 1)


def drift(points: DataFrame, period: Column) -> DataFrame:
    """(label, period, count, share, x, y, shift): each cluster's share and centre by period, and how far the centre moved since its last period."""
    p = points.withColumn("period", period)
    g = p.groupBy("label", "period").agg(F.count("*").alias("count"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    total = p.groupBy("period").agg(F.count("*").alias("total"))
    w = Window.partitionBy("label").orderBy("period")
    shift = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / 190
    out = g.join(F.broadcast(total), "period").withColumn("shift", F.round(F.coalesce(shift, F.lit(0.0)), 4))
    return out.select("label", "period", "count", F.round(F.col("count") / F.col("total"), 4).alias("share"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "shift")


def era(points: DataFrame, first: int, last: int, top: int = 10) -> DataFrame:
    """(label, count, min_unit, max_unit) of the largest clusters in a range of units."""
    g = points.where(F.col("unit").between(first, last)).groupBy("label").agg(F.count("*").alias("count"), F.min("unit").alias("min_unit"), F.max("unit").alias("max_unit"))
    return g.orderBy(F.desc("count"), "label").limit(top)
