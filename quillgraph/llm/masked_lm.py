"""LM scoring by masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts each word from both sides.

Words are hashed to ids; their number grows with the corpus, one for each ``PLACES_AN_ID`` places, from ``LEAST_WORDS`` to
``MOST_WORDS`` (a bound on what is broadcast; beyond it rare words share ids). Counts of the ids over all documents are the model's
vocabulary statistics. The network sees the ``WINDOW`` ids on either side of a masked place (each place has its own input
table), has one tanh layer, and predicts the class of the masked word; within a class a word has its share of the class's
count. Frequent ids are classes of their own, the others are dealt to classes of about equal frequency.

Training is distributed: in each of ``rounds`` rounds every partition starts from the current weights, masks every place
of all its documents in turn, takes mini-batch steps, and the weights are averaged, weighted by masked places, in two levels of
about the square root of the partitions each. All places of all documents take part in every round.

A document's score is the sum over its places of the log-probability of the word given its window.

Edge cases: null and empty texts and texts without words have no places, sum 0 and a null mean; without any document the
network stays at its random start; repeated rows get equal scores; a long text is processed in stretches with the window's
margin, so its score is that of the whole text; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_column, word_hashes

LEAST_WORDS, MOST_WORDS, PLACES_AN_ID = 1 << 16, 1 << 20, 16
INPUTS, CLASSES, HIDDEN, WINDOW = 4096, 64, 32, 2
STRETCH, BATCH = 1 << 14, 2048
RESULT = "n_words LONG, log_likelihood DOUBLE, mean_log_likelihood DOUBLE"


@dataclass(frozen=True)
class Vocabulary:
    """By word id: its class, its input row, and the log of its share of the class."""

    classes: np.ndarray
    inputs: np.ndarray
    within: np.ndarray

    def ids(self, raw: bytes) -> np.ndarray:
        """Ids of a text's encoded words."""
        return np.frombuffer(raw, np.uint32) & np.uint32(len(self.classes) - 1)


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """From the counts of all ids: the most frequent half of the classes hold one id each, the others about equal shares of the rest."""
    order, words = np.argsort(-counts, kind="stable"), len(counts)
    c = counts + 0.5
    single = CLASSES // 2
    classes = np.zeros(words, np.int16)
    classes[order[:single]] = np.arange(single)
    mass = np.cumsum(c[order[single:]])
    classes[order[single:]] = single + np.minimum(CLASSES - single - 1, (mass - c[order[single:]]) / mass[-1] * (CLASSES - single)).astype(np.int16)
    inputs = np.zeros(words, np.int16)
    # rare ids share the input rows of their class; row 0 is the margin of a text
    inputs[order] = np.where(np.arange(words) < INPUTS - CLASSES - 1, np.arange(words) + CLASSES + 1, classes[order] + 1)
    return Vocabulary(classes, inputs, np.log(c / np.bincount(classes, c, CLASSES)[classes]).astype(np.float32))


def random_start(seed: int) -> list[np.ndarray]:
    """Input tables by place, hidden offsets, output weights, output offsets."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.1, (2 * WINDOW, INPUTS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.zeros(CLASSES, np.float32)]


def contexts(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Input rows around the places ``at`` of ``rows``, which has WINDOW margin rows at either end; shape (place, 2 * WINDOW)."""
    steps = np.array([d for d in range(-WINDOW, WINDOW + 1) if d])
    return rows[at[:, None] + WINDOW + steps]


def forward(net: list[np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden values, class log-probabilities)."""
    tables, b1, w2, b2 = net
    h = tables[0][ctx[:, 0]]
    for k in range(1, 2 * WINDOW):
        h += tables[k][ctx[:, k]]
    h = np.tanh(h + b1)
    z = h @ w2 + b2
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return h, z


def train_step(net: list[np.ndarray], squares: list[np.ndarray], ctx: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step on the mean cross-entropy; only the input rows that occur are touched."""
    tables, b1, w2, b2 = net
    h, z = forward(net, ctx)
    g = np.exp(z)
    g[np.arange(len(g)), target] -= 1
    g /= len(g)
    gh = (g @ w2.T) * (1 - h * h)
    for x, grad, s in ((w2, h.T @ g, squares[2]), (b2, g.sum(0), squares[3]), (b1, gh.sum(0), squares[1])):
        s += grad * grad
        x -= rate * grad / (np.sqrt(s) + 1e-6)
    for k in range(2 * WINDOW):
        order = np.argsort(ctx[:, k], kind="stable")  # 16-bit numbers: one radix sort
        met = ctx[order, k]
        starts = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        rows, grad = met[starts], np.add.reduceat(gh[order], starts, axis=0)
        total = squares[0][k][rows] + grad * grad
        squares[0][k][rows] = total
        tables[k][rows] -= rate * grad / (np.sqrt(total) + 1e-6)


def word_ids(text: bytes | None) -> np.ndarray:
    """32-bit hashes of the words; a model takes as many of their bits as it has ids."""
    return word_hashes(text).astype(np.uint32)


def with_ids(docs: DataFrame, *, text_col: str = "text", out: str = "word_ids") -> DataFrame:
    """Append the binary ``out``: the word ids of the whole text as 32-bit numbers. What ``fit`` and ``score`` read."""
    return append_column(docs, [text_col], out, T.BinaryType(), lambda: lambda c: pa.array([word_ids(t.as_py()).tobytes() for t in c.cast(pa.binary())], pa.binary()))


def _margins(inputs: np.ndarray) -> np.ndarray:
    pad = np.zeros(WINDOW, inputs.dtype)
    return np.concatenate([pad, inputs, pad])


def count_words(encoded: DataFrame) -> np.ndarray:
    """Counts of all word ids over all documents (one column of ids); as many as the corpus asks for."""
    places = encoded.agg(F.sum(F.octet_length(encoded.columns[0])).alias("n")).first()["n"] or 0
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (places // 4 // PLACES_AN_ID).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words, np.int64)
        for b in batches:
            at, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32) & np.uint32(words - 1), return_counts=True)
            total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    found = encoded.mapInArrow(run, "id INT, n LONG").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(words)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return counts


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    net: list[np.ndarray]


def fit(encoded: DataFrame, *, ids_col: str = "word_ids", rounds: int = 1, rate: float = 0.1, seed: int = 31) -> Model:
    """Train on all documents (of ``with_ids``, best stored: they are read in every round). Each round masks every place once."""
    sc = encoded.sparkSession.sparkContext
    texts = encoded.select(ids_col)
    voc = vocabulary(count_words(texts))
    net = random_start(seed)
    sizes = [x.size for x in net]
    block = 1 << 12
    n_blocks = -(-sum(sizes) // block)
    level = max(1, int(np.sqrt(texts.rdd.getNumPartitions())))
    for _ in range(rounds):
        shared = sc.broadcast((voc, net))

        def train(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, start = shared.value
            own, squares = [x.copy() for x in start], [np.full_like(x, 1e-4) for x in start]
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            ready = seen = 0

            def step() -> None:
                nonlocal waiting, ready, seen
                ctx, target = np.concatenate([c for c, _ in waiting]), np.concatenate([t for _, t in waiting])
                for at in range(0, len(ctx), BATCH):
                    train_step(own, squares, ctx[at : at + BATCH], target[at : at + BATCH], rate)
                seen, waiting, ready = seen + len(ctx), [], 0

            for b in batches:
                for t in b.column(0):
                    w = v.ids(t.as_py())
                    if len(w):
                        rows = _margins(v.inputs[w])
                        for first in range(0, len(w), STRETCH):
                            at = np.arange(first, min(len(w), first + STRETCH))
                            waiting.append((contexts(rows, at), v.classes[w[at]]))
                            ready += len(at)
                            if ready >= 4 * BATCH:
                                step()
            if waiting:
                step()
            flat = np.concatenate([x.ravel() for x in own]).astype(np.float32)
            flat = np.concatenate([flat, np.zeros(n_blocks * block - len(flat), np.float32)]).reshape(n_blocks, block)
            if seen:
                part = TaskContext.get().partitionId() % level
                yield pa.RecordBatch.from_arrays([pa.array(range(n_blocks), pa.int32()), pa.array([part] * n_blocks, pa.int32()), pa.array([float(seen)] * n_blocks), pa.array([x.tobytes() for x in flat], pa.binary())], names=["block", "part", "weight", "w"])

        def average(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            weight = parts["weight"].to_numpy()
            total = np.zeros(block)
            for x, w in zip(parts["w"], weight, strict=True):
                total += np.frombuffer(x, np.float32) * w
            return pd.DataFrame({"block": [key[0]], "part": [0], "weight": [weight.sum()], "w": [(total / weight.sum()).astype(np.float32).tobytes()]})

        kind = "block INT, part INT, weight DOUBLE, w BINARY"
        halfway = texts.mapInArrow(train, kind).groupBy("block", "part").applyInPandas(average, kind)
        got = halfway.groupBy("block").applyInPandas(average, kind).select("block", "w").toArrow()
        if got.num_rows:
            by = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
            flat = np.concatenate([np.frombuffer(by[i], np.float32) for i in range(n_blocks)])
            ends = np.cumsum([0, *sizes])
            net = [flat[a:b].reshape(x.shape).copy() for a, b, x in zip(ends[:-1], ends[1:], net, strict=True)]
    return Model(voc, net)


def log_likelihood(model: Model, w: np.ndarray) -> float:
    """Sum of the log-probabilities of all places of a text's word ids."""
    v = model.vocabulary
    rows, total = _margins(v.inputs[w]), 0.0
    for start in range(0, len(w), STRETCH):
        at = np.arange(start, min(len(w), start + STRETCH))
        _, z = forward(model.net, contexts(rows, at))
        total += float(z[np.arange(len(at)), v.classes[w[at]]].sum(dtype=np.float64) + v.within[w[at]].sum(dtype=np.float64))
    return total


def score(encoded: DataFrame, model: Model, *, ids_col: str = "word_ids", out: str = "lm") -> DataFrame:
    """Append the struct ``out`` (``RESULT``)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(c: pa.Array) -> pa.Array:
            n, s = [], []
            for t in c:
                w = m.vocabulary.ids(t.as_py())
                n.append(len(w))
                s.append(log_likelihood(m, w) if len(w) else 0.0)
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array([x / k if k else None for x, k in zip(s, n, strict=True)], pa.float64())], names=["n_words", "log_likelihood", "mean_log_likelihood"])

        return run

    return append_column(encoded, [ids_col], out, RESULT, make)
