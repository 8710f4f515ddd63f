"""Vector code compression: product codes on integers, with segment-mean lower bounds in the assignment.

A component becomes ``floor(scale * x)``; a vector is cut into ``parts`` equal parts, each coded by its nearest entry of the
part's codebook. Entries are filtered coarse to fine: over blocks of 16, 8 and 4 components (1, 2 and 4 blocks for a part of
16) the squared distance is at least the sum of (difference of block sums)^2 / block size plus (difference of residual
norms)^2, as block means and residuals are orthogonal. An entry goes when even that, less rounding slack, exceeds the best
exact distance so far; survivors get exact integer distances, and ties go to the lower index.

A training round sums, in each task, the parts of each entry; Spark adds these sums up. Codebooks (``parts * entries``
vectors, whatever the input) are all that the driver holds. Every row is read in every round: nothing is sampled.

Edge cases: rows whose vector is null or holds null or non-finite components go; vectors of another length than that of the
smallest id, or of a length that ``parts`` doesn't divide, have null code and error; with fewer rows than entries there are as
many entries as rows; rows with equal ids count each (of equal ids at the bound the ones with the smaller vectors open the
codebook), and a null id is the largest; an empty table gives no rows; extra columns pass through. Components are
cut at a bound so that distances fit into a long (2^27 at 64 components: |x| up to 131,072 at scale 1024).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import append_column, arrow_type, bounded_batches, free_name, give_back, stored

#: Vectors compared at a time in a task.
BLOCK = 1024
CODED = "code STRING, error LONG"


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: integers, one row an entry."""

    entries: list[np.ndarray]
    size: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.col(vector)
    return F.coalesce(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def integers(vectors: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have ``size`` components, their integers)."""
    have = np.array(vectors.value_lengths().to_numpy(zero_copy_only=False) == size, bool) if len(vectors) else np.zeros(0, bool)
    limit = 2.0 ** ((62 - (size - 1).bit_length()) // 2 - 1)  # squared distances fit into a long
    flat = vectors.filter(pa.array(have)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return have, np.clip(np.floor(scale * flat), -limit, limit).astype(np.int64).reshape(-1, size) if size else np.zeros((0, 0), np.int64)


def levels(width: int) -> list[int]:
    """Numbers of blocks, coarse to fine, that divide a part."""
    return [b for b in (1, 2, 4) if width % b == 0 and b < width] or [1]


class Bounds:
    """Block sums and residual norms of rows at each level."""

    def __init__(self, rows: np.ndarray) -> None:
        width = rows.shape[1]
        x = rows.astype(np.float64)
        self.square = (x * x).sum(1)
        self.levels = []
        for b in levels(width):
            s = x.reshape(len(x), b, width // b).sum(2)
            mean = (s * s).sum(1) / (width // b)
            self.levels.append((s, np.sqrt(np.maximum(0, self.square - mean)), width // b))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, exact squared distance) of the nearest entry of each row; the lower index on ties."""
    index, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    entries = Bounds(book)
    for at in range(0, len(rows), BLOCK):
        x = rows[at : at + BLOCK]
        own = Bounds(x)
        # slack: what rounding can add to a bound, far over 2^-52 of the largest square
        slack = 1e-9 * (own.square + entries.square.max() + 1)
        every = np.arange(len(x))
        (s, r, m), (t, q, _) = own.levels[0], entries.levels[0]
        low = sum((s[:, k, None] - t[None, :, k]) ** 2 for k in range(s.shape[1])) / m + (r[:, None] - q[None]) ** 2
        guess = low.argmin(1)
        upper = ((x - book[guess]) ** 2).sum(1)
        i, j = np.nonzero(low <= (upper + slack)[:, None])
        for (s, r, m), (t, q, _) in zip(own.levels[1:], entries.levels[1:], strict=True):
            finer = ((s[i] - t[j]) ** 2).sum(1) / m + (r[i] - q[j]) ** 2
            # the entry with the least bound of each row gives a tighter distance
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            least = np.minimum.reduceat(finer, first)
            at_least = np.flatnonzero(finer == np.repeat(least, np.diff(np.concatenate([first, [len(i)]]))))
            guess = guess.copy()
            guess[i[at_least]] = j[at_least]
            upper = np.minimum(upper, ((x - book[guess]) ** 2).sum(1))
            keep = finer <= (upper + slack)[i]
            i, j = i[keep], j[keep]
        exact = ((x[i] - book[j]) ** 2).sum(1)
        order = np.lexsort((j, exact, i))
        one = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])]
        index[at + every], best[at + every] = j[one], exact[one]
    return index, best


def part(rows: np.ndarray, p: int, parts: int) -> np.ndarray:
    width = rows.shape[1] // parts
    return rows[:, p * width : (p + 1) * width]


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and floor of the mean, from the parts of the ``entries`` smallest ids; unused entries stay."""
    ok = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    head = ok.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).toArrow()
    size = len(head.column(1)[0]) if head.num_rows else 0
    if not size or size % parts:
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, 0)
    ok = ok.where(F.size("vector") == size)
    opening = ok.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).toArrow().column(1).combine_chunks()
    first = integers(opening, size, scale)[1]
    books = [part(first, p, parts).copy() for p in range(parts)]
    width = size // parts
    bounded_batches(vectors.sparkSession)
    for _ in range(rounds):

        def total(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, len(books[0]), width), np.int64), np.zeros((parts, len(books[0])), np.int64)
            for b in batches:
                rows = integers(b.column(0), size, scale)[1]
                for p in range(parts):
                    x = part(rows, p, parts)
                    k = nearest(x, books[p])[0]
                    np.add.at(sums[p], k, x)
                    counts[p] += np.bincount(k, minlength=len(books[p]))
            p, k = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, k]), pa.array(list(sums[p, k]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
            give_back()

        partial = ok.select("vector").mapInArrow(total, "part INT, entry INT, n LONG, sums ARRAY<LONG>")
        found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in found:
            books[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return Codebooks(books, size)


def encode(vectors: DataFrame, books: Codebooks, *, vector_col: str = "embedding", scale: int = 1024, out: str = "coded") -> DataFrame:
    """Usable rows with the struct ``out`` (``CODED``): two hex digits a part, and the exact squared distance; null for other lengths."""
    parts, arrow = len(books.entries), arrow_type(CODED)
    digits = max(2, -(-max(len(books.entries[0]) - 1, 1).bit_length() // 4))

    def make():
        def run(vectors: pa.Array) -> pa.Array:
            have, rows = integers(vectors, books.size, scale)
            if not books.size:
                return pa.array([{"code": None, "error": None}] * len(vectors), arrow)
            codes, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
            for p in range(parts):
                codes[:, p], far = nearest(part(rows, p, parts), books.entries[p])
                error += far
            said = iter(zip(codes.tolist(), error.tolist(), strict=True))
            out = []
            for x in have.tolist():
                c, e = next(said) if x else (None, None)
                out.append({"code": "".join(f"{k:0{digits}x}" for k in c) if x else None, "error": e})
            return pa.array(out, arrow)

        return run

    return append_column(vectors.where(usable(vector_col)), [vector_col], out, CODED, make)


#: Labels up to this number have their totals broadcast; more are joined by a shuffle.
FEW_LABELS = 10_000


def with_label_error(coded: DataFrame, *, label_col: str = "label", error_col: str = "error", out: str = "label_error") -> DataFrame:
    """Append the error summed over rows of an equal label, nulls together; the totals are sums by label, so a hot label is no hot task."""
    key, total = free_name(coded, "label_key"), free_name(coded, "label_total")
    totals = stored(coded.groupBy(F.col(label_col).alias(key)).agg(F.sum(error_col).alias(total)), "label-error")
    few = totals.count() <= FEW_LABELS
    joined = coded.join(F.broadcast(totals) if few else totals, F.col(label_col).eqNullSafe(F.col(key)), "left")
    return joined.withColumn(out, F.col(total)).drop(key, total)


def _oracle() -> str:
    """Unrolled rounds: squared distances as |x|^2 - 2xy + |y|^2 in doubles, which hold these integers exactly."""
    steps = [
        """row AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
piece AS MATERIALIZED (SELECT r, p, v[16 * p + 1:16 * p + 16] AS v, list_dot_product(v[16 * p + 1:16 * p + 16], v[16 * p + 1:16 * p + 16]) AS s FROM row, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS k, v, s FROM piece WHERE r <= 256)"""
    ]
    assign = "SELECT r, x.p, min(struct_pack(d := CAST(x.s - 2 * list_dot_product(x.v, y.v) + y.s AS BIGINT), k := y.k)) AS b FROM piece x JOIN book{0} y ON x.p = y.p GROUP BY r, x.p"
    for i in range(4):
        steps.append(f"near{i} AS MATERIALIZED ({assign.format(i)})")
        steps.append(f"""mean{i} AS (SELECT p, k, list(m ORDER BY j) AS v FROM (
  SELECT p, k, j, CAST(floor(sum(c) / count(*)) AS DOUBLE) AS m FROM (SELECT x.p, n.b.k AS k, unnest(x.v) AS c, unnest(range(16)) AS j FROM piece x JOIN near{i} n ON x.r = n.r AND x.p = n.p) GROUP BY p, k, j) GROUP BY p, k),
book{i + 1} AS MATERIALIZED (SELECT o.p, o.k, coalesce(m.v, o.v) AS v, list_dot_product(coalesce(m.v, o.v), coalesce(m.v, o.v)) AS s FROM book{i} o LEFT JOIN mean{i} m ON o.p = m.p AND o.k = m.k)""")
    steps.append(f"last AS MATERIALIZED ({assign.format(4)})")
    steps.append("coded AS (SELECT r, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM last GROUP BY r)")
    steps.append("digest AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS h FROM book4)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM row JOIN coded USING (r), digest"


ORACLE_SQL = _oracle()
