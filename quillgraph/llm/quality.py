"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives ``len(STATISTICS)`` statistics. A random map of cosines approximates a Gaussian kernel over them; the normal
equations of the ridge scores are summed within partitions, then over them; a monotone step curve (pool adjacent violators)
turns raw scores into probabilities.

The curve is fitted on labelled rows apart from those of the ridge, the classes at their shares among all labels.

The fit reads at most ``2 * rows_per_class`` labelled documents (a documented bound), so the normal equations have
``features ** 2`` numbers and few partitions; scoring is one pass without a shuffle.

Edge cases: null and empty texts have all statistics 0 and get the score of that point; without labelled rows every score is
0.5; with one class only, the score is that class; very long texts are read whole; repeated rows get equal scores; an empty table gives no rows; extra columns pass
through, but for one named like the output, which it replaces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_column, labelled_sample, stored

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "mark_share", "shout_share", "symbol_share", "distinct_words",
    "repeat_next", "top_word_share", "top_pair_share", "repeated_lines", "line_length", "sentence_words", "compressed_share", "longest_word", "non_ascii_share",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = b".,;:"
_SHOUT = b"!?"
_SYMBOL = bytes(b for b in range(33, 127) if not (chr(b).isalnum() or b in _MARK + _SHOUT))
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS; all 0 for a text without a word."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    n, chars = len(words), len(raw)
    if not n:
        return [0.0] * len(STATISTICS)

    def share(kind: bytes) -> float:
        return (chars - len(raw.translate(None, kind))) / chars

    count = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(str.isupper, text)) / len(text)
    ends = sum(raw.count(x) for x in (b".", b"!", b"?"))
    return [
        np.log1p(chars), np.log1p(n), sum(map(len, words)) / n, upper, share(_DIGIT), share(_MARK), share(_SHOUT), share(_SYMBOL), len(count) / n**0.9,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(count.values()) / n, max(pairs.values(), default=0) / n, 1 - len(set(lines)) / len(lines),
        np.log1p(chars / len(lines)), np.log1p(n / (1 + ends)), min(1.5, len(zlib.compress(raw, 1)) / chars), np.log1p(max(map(len, words))), share(_HIGH),
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    theta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray


def fourier(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.hstack([np.cos(z @ model.w + model.b) * np.sqrt(2 / len(model.b)), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and the rising levels through (x, y)."""
    order = np.argsort(x, kind="stable")
    w = np.ones(len(x)) if weight is None else weight[order]
    blocks: list[list[float]] = []  # sum of w*y, of w, of w*x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w.tolist(), strict=True):
        blocks.append([b * c, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    m = np.array(blocks)
    return m[:, 2] / m[:, 1], m[:, 0] / m[:, 1]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: Column | None = None, rows_per_class: int = 6000, features: int = 256, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 17) -> Model:
    """Fit on at most ``rows_per_class`` labelled documents a class; ``keep`` (over the labels) says which labels may be used."""
    spark, k = docs.sparkSession, len(STATISTICS)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (k, features)), rng.uniform(0, 2 * np.pi, features)
    sample, weigh = labelled_sample(labels, id_col, label_col, F.lit(True) if keep is None else keep, rows_per_class)
    chosen = F.broadcast(sample)  # at most 2 * rows_per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id") == F.col("_label_id"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            x = [statistics(t.as_py()) for t in r.column(2)]
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "part", "x"])

    table = stored(rows.select("_label", "_part", "text").mapInArrow(measure, "y INT, part INT, x ARRAY<DOUBLE>"), "quality-sample")
    some = {(r["y"], r["part"] == 0) for r in table.select("y", "part").distinct().collect()}
    # fitted on five parts of six and calibrated on the other; on all rows where one of the two lacks a class
    split = len(some) == 4
    known, apart = (table.where("part > 0"), table.where("part = 0")) if split else (table, table)
    known, apart = known.select("y", "x"), apart.select("y", "x")
    sums = known.select(F.count("*").alias("n"), F.sum("y").alias("pos"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k))).first()
    n, pos = sums["n"], sums["pos"] or 0
    empty = Model(np.zeros(k), np.ones(k), w, b, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not n or pos in (0, n):
        return empty if not n else Model(**empty.__dict__ | {"levels": np.array([float(pos > 0)])})
    base = Model(**empty.__dict__ | {"mean": np.array([sums[f"m{i}"] for i in range(k)]), "scale": np.array([max(1e-6, sums[f"s{i}"]) for i in range(k)])})
    shared, weight = spark.sparkContext.broadcast(base), (n / 2 / (n - pos), n / 2 / pos)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for r in batches:
            y = r.column(0).to_numpy()
            z = fourier(np.array(r.column(1).to_pylist()), shared.value)
            c = np.where(y == 1, weight[1], weight[0])[:, None]
            total += z.T @ (np.hstack([z, y[:, None]]) * c)
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = known.coalesce(16).mapInArrow(partial, "i INT, row ARRAY<DOUBLE>")
    summed = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    normal = np.zeros((features + 1, features + 2))
    normal[summed.column(0).to_numpy(), summed.column(1).to_numpy()] = summed.column(2).to_numpy()
    theta = np.linalg.solve(normal[:, :-1] + ridge * n * np.eye(features + 1), normal[:, -1])
    scored = apart.toArrow()  # bounded by 2 * rows_per_class
    raw, y = fourier(np.array(scored.column(1).to_pylist()), base) @ theta, scored.column(0).to_numpy().astype(float)
    knots, levels = isotonic(raw, y, np.where(y == 1, weigh[1], weigh[0]))
    return Model(**base.__dict__ | {"theta": theta, "knots": knots, "levels": np.clip(levels, 0.001, 0.999)})


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """Append the double ``out``: the calibrated probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(c: pa.Array) -> pa.Array:
            x = np.array([statistics(t.as_py()) for t in c])
            return pa.array(np.interp(fourier(x, m) @ m.theta, m.knots, m.levels))

        return run

    return append_column(docs, [text_col], out, T.DoubleType(), make)
