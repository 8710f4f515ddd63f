"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors.

1. Word and word-stem lexicons are induced from a bounded sample of labelled documents and dealt to ``LEXICON_VOTERS`` voters;
   pattern voters (repeated hits, shouting, runs of marks, density of hits) join them. A voter fires or doesn't.
2. All documents vote. The label model sees only how often each pattern of votes occurs (at most ``2 ** VOTERS`` patterns at
   any corpus size) and estimates by expectation-maximisation the class balance, each voter's accuracy in either class, and
   the correlations of voters: each voter depends on the class and on one other voter, along the tree of the largest
   conditional mutual information.
3. A linear (logistic) classifier over indicative words and stems learns the posteriors of a bounded sample of documents; a
   logistic curve calibrates its score, fitted on labelled rows that the lexicon hasn't seen, classes at their shares among all labels.

Edge cases: null, empty and wordless texts have no votes and no features and get the intercept's score; without any labelled
toxic row there is no lexicon and every score is the share of toxic labels (0 without labels); very long texts are read
whole; repeated rows get equal scores; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import append_column, labelled_sample, stored, word_hashes
from .order_minhash import items, sketch

LEXICON_VOTERS, PATTERNS = 8, ("two_hits", "dense_hits", "shouting", "mark_runs")
VOTERS = LEXICON_VOTERS + len(PATTERNS)
STEMS = (3, 4, 5, 6, 7, 8)
RESULT = "score DOUBLE, votes INT, posterior DOUBLE"
#: Words whose features a task remembers.
CACHE = 300_000
_UPPER = bytes(range(65, 91))
#: A-Z to a-z, bytes below 0x80 that are no letters to blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def letter_words(raw: bytes) -> list[bytes]:
    """Words of letters; what isn't ASCII counts as a letter."""
    return raw.translate(_LETTERS).split()


def features(word: str) -> list[str]:
    """A word and its stems; a stem ends with ``*``."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


@dataclass(frozen=True)
class Model:
    """vocabulary: feature -> column; lexicon: feature -> voter; posterior by pattern; weights, intercept, slope and offset."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    lexicon: dict[str, int] = field(default_factory=dict)
    posterior: np.ndarray = field(default_factory=lambda: np.zeros(1 << VOTERS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None


class _Found(dict):
    """Word -> the columns of its features and the voters of its lexicon entries; None if it has neither."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, w: bytes) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        fs = features(w.decode("utf-8", "replace"))
        c, v = (tuple(d[f] for f in fs if f in d) for d in (self.model.vocabulary, self.model.lexicon))
        if len(self) > CACHE:  # the words that came first are the most frequent ones, so they stay
            kept = dict(islice(self.items(), CACHE // 2))
            self.clear()
            self.update(kept)
        self[w] = out = (c, v) if c or v else None
        return out


class Reader:
    """Reads a text: its vote pattern and the columns of its features. Looks each word up once."""

    def __init__(self, model: Model) -> None:
        self.cache = _Found(model)

    def read(self, text: str | None) -> tuple[int, list[int]]:
        raw = (text or "").encode("utf-8", "replace")
        found = letter_words(raw)
        n, columns, votes, hits = len(found), set(), 0, 0
        for c, v in filter(None, map(self.cache.__getitem__, found)):
            columns.update(c)
            hits += bool(v)
            for k in v:
                votes |= 1 << k
        if n:
            caps, runs = len(raw) - len(raw.translate(None, _UPPER)), sum(map(raw.count, (b"!!", b"??", b"?!", b"!?")))
            for k, fires in enumerate((hits > 1, hits > 0.02 * n, caps > 0.3 * len(raw), runs > 0.1 * n)):
                votes |= fires << LEXICON_VOTERS + k
        return votes, sorted(columns)


def induce(rows: DataFrame, *, most: int = 4096, least: float = 3.0, surprise: float = 24.0) -> tuple[dict[str, int], dict[str, int]]:
    """(vocabulary, lexicon) from rows (text, _label), by the counts of toxic and clean documents with a feature.

    The vocabulary has at most ``most`` features whose counts surprise by more than ``surprise`` (twice the log-likelihood
    ratio) and that speak for toxicity; the lexicon has those with log-odds over ``least``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[label].update({f for w in set(letter_words((text.as_py() or "").encode("utf-8", "replace"))) for f in features(w.decode("utf-8", "replace"))})
        keys = list(seen[0] | seen[1])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array([s[x] for x in keys], pa.int64()) for s in seen)], names=["f", "clean", "toxic"])

    sizes = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return {}, {}
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    table = rows.select("text", "_label").mapInArrow(count, "f STRING, clean LONG, toxic LONG").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # a feature must tell by more than chance: the log-likelihood ratio of its counts, at a level that holds for millions of features
    both, share = F.col("toxic") + F.col("clean"), n1 / (n0 + n1)

    def term(c: str, expected: float) -> Column:
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * expected))).otherwise(0.0)

    ratio = 2 * (term("toxic", share) + (term("clean", 1 - share) if n0 else F.lit(0.0)))
    best = table.select("f", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") > 0) & (F.col("ratio") > surprise)).orderBy(F.desc("ratio"), "f").limit(most).collect()
    vocabulary = {r["f"]: i for i, r in enumerate(best)}
    strong = [r["f"] for r in best if r["odds"] > least]
    # a feature that extends a stem already in the lexicon adds nothing of its own: it goes to the stem's voter
    lexicon: dict[str, int] = {}
    turn = 0
    for f in sorted(strong, key=lambda f: (len(f.rstrip("*")), f)):
        stems = [f[:k] + "*" for k in STEMS if f[:k] + "*" in lexicon and f != f[:k] + "*"]
        if stems:
            lexicon[f] = lexicon[stems[0]]
        else:
            lexicon[f], turn = turn % LEXICON_VOTERS, turn + 1
    return vocabulary, lexicon


def without_copies(rows: DataFrame) -> DataFrame:
    """Rows (text, _label) of a bounded sample, without those that agree in an item sketch with a row before them.

    In a group of copies every word looks as indicative as the one that earned the label, so one row of a group is enough.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.default_rng(7).integers(1, 1 << 63, 12).astype(np.uint64) | np.uint64(1)
        for b in batches:
            found = [sketch(items(word_hashes(t.as_py()), 3), seeds, 1) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=["text", "_label", "sketch"])

    table = stored(rows.mapInArrow(sketches, "text STRING, _label INT, sketch ARRAY<LONG>"), "toxicity-sketches")
    places = table.select(F.xxhash64("text").alias("h"), "sketch").distinct().orderBy("h").toArrow()  # bounded by the sample
    seen: set[tuple[int, int]] = set()
    kept = []
    for h, values in zip(places.column(0).to_pylist(), places.column(1).to_pylist(), strict=True):
        keys = set(enumerate(values))
        if not keys & seen:
            kept.append(h)
        seen |= keys
    chosen = rows.sparkSession.createDataFrame(pa.table({"h": pa.array(kept, pa.int64())}))
    return table.select("text", "_label").dropDuplicates(["text"]).join(F.broadcast(chosen), F.xxhash64("text") == F.col("h"), "left_semi")


def label_model(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int = 60) -> np.ndarray:
    """Posterior of class 1 for each row of ``patterns`` (0 or 1 by voter), by EM in the tree-augmented class model.

    ``start`` is the posterior to begin with (it names the classes). A second tree is taken once the first has settled.
    """
    m = patterns.shape[1]
    q = start.copy()

    def pair_table(weight: np.ndarray, i: int, j: int) -> np.ndarray:
        t = np.full((2, 2), 0.1)
        np.add.at(t, (patterns[:, i], patterns[:, j]), weight)
        return t

    parent = [-1] * m
    for k in range(steps):
        weights = counts * (1 - q), counts * q
        if k in (10, 30):  # the tree of the voters' correlations within the classes
            gain = np.zeros((m, m))
            for i in range(m):
                for j in range(i):
                    for w in weights:
                        t = pair_table(w, i, j)
                        p = t / t.sum()
                        gain[i, j] = gain[j, i] = gain[i, j] + t.sum() * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0)))).sum()
            parent, inside = [-1] * m, {0}
            while len(inside) < m:
                i, j = max(((i, j) for i in range(m) if i not in inside for j in inside), key=lambda x: (gain[x], -x[0], -x[1]))
                parent[i] = j if gain[i, j] > 5 else -1
                inside.add(i)
        logs = []
        for w in weights:
            log = np.full(len(patterns), np.log(w.sum() + 1e-3))
            for i in range(m):
                if parent[i] < 0:
                    one = (w @ patterns[:, i] + 0.1) / (w.sum() + 0.2)
                    log += np.log(np.where(patterns[:, i] == 1, one, 1 - one))
                else:
                    t = pair_table(w, i, parent[i])
                    log += np.log(t / t.sum(0))[patterns[:, i], patterns[:, parent[i]]]
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if k > 31 and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q


def logistic(rows: list[list[int]], target: np.ndarray, width: int, steps: int = 200, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression of ``target`` (0 to 1) on binary features, by accelerated gradient steps; classes weigh alike."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    c = target / share / 2 + (1 - target) / (1 - share) / 2
    w, b, vw, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
    seen_w, seen_b = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, w[flat], len(rows)) + b
        g = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        gw, gb = np.bincount(flat, g[owner], width) + ridge * w, g.sum()
        vw, vb = 0.8 * vw + 0.2 * gw, 0.8 * vb + 0.2 * gb
        seen_w, seen_b = 0.99 * seen_w + 0.01 * gw**2, 0.99 * seen_b + 0.01 * gb**2
        w, b = w - 0.1 * vw / (np.sqrt(seen_w) + 1e-6), b - 0.1 * vb / (np.sqrt(seen_b) + 1e-6)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: Column | None = None, rows_per_class: int = 5000, training_rows: int = 20_000) -> Model:
    """Fit on at most ``rows_per_class`` labelled documents a class and about ``training_rows`` documents with posteriors of either kind.

    ``keep`` (over the labels) says which labels may be used. The vote patterns are counted over all documents.
    """
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample, weigh = labelled_sample(labels, id_col, label_col, F.lit(True) if keep is None else keep, rows_per_class)
    known = base.join(F.broadcast(sample), F.col("id") == F.col("_label_id")).select("text", "_label", "_part")
    known = stored(known, "toxicity-sample")
    vocabulary, lexicon = induce(without_copies(known.where("_part > 0").select("text", "_label")))
    model = Model(vocabulary, lexicon)
    if not lexicon:
        n = known.select(F.when(F.col("_label") == 1, weigh[1]).otherwise(weigh[0]).alias("w"), "_label").agg(F.sum(F.col("w") * F.col("_label")) / F.sum("w")).first()[0]
        return replace(model, constant=float(n or 0.0))
    shared = sc.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(shared.value), Counter()
        for b in batches:
            seen.update(reader.read(t.as_py())[0] for t in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            got = [reader.read(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.int32()), pa.array([c for _, c in got], pa.list_(pa.int32())), b.column(1)], names=["votes", "columns", "_label"])

    found = base.select("text").mapInArrow(count, "votes INT, n LONG").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").toArrow()
    votes, counts = found.column(0).to_numpy(), found.column(1).to_numpy().astype(float)
    bits = (votes[:, None] >> np.arange(VOTERS) & 1).astype(np.int64)
    # calibration: labelled rows that induced nothing, or all where these lack a class
    apart = known.where("_part = 0")
    if apart.select("_label").distinct().count() < 2:
        apart = known
    told = apart.select("text", "_label").mapInArrow(lambda it: read(b.select([0, 1]) for b in it), "votes INT, columns ARRAY<INT>, _label INT").toArrow()
    v, y = told.column(0).to_numpy(), told.column(2).to_numpy().astype(float)
    # where the labels put each pattern to begin with: few labels, so lexicon votes stand in for patterns that have none
    start = np.where((bits[:, :LEXICON_VOTERS]).any(1), 0.9, 0.02)
    posterior = np.where(np.arange(1 << VOTERS) & (1 << LEXICON_VOTERS) - 1, 0.9, 0.02)  # of patterns that nobody voted
    posterior[votes] = label_model(bits, counts, start)
    # train on posteriors: documents of all kinds, a bounded hash sample of each side of one half, no labels of theirs
    sides = posterior[votes] >= 0.5
    take = {int(s): max(1, int(counts[sides == s].sum() // (training_rows // 2))) for s in (False, True)}
    every = base.withColumn("h", F.abs(F.xxhash64("id", F.lit(3)) % (1 << 30)))
    model = replace(model, posterior=posterior)
    shared2 = sc.broadcast(model)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, p = Reader(shared2.value), shared2.value.posterior
        for b in batches:
            some = []
            for t, h in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if h % min(take.values()) and h % max(take.values()):
                    continue
                vote, columns = reader.read(t.as_py())
                if h % take[int(p[vote] >= 0.5)] == 0:
                    some.append((columns, float(p[vote])))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.list_(pa.int32())), pa.array([x for _, x in some], pa.float64())], names=["columns", "p"])

    train = every.select("text", "h").mapInArrow(pick, "columns ARRAY<INT>, p DOUBLE").toArrow()
    weights, intercept = logistic(train.column(0).to_pylist(), train.column(1).to_numpy(), len(vocabulary))
    z = np.array([weights[c].sum() for c in told.column(1).to_pylist()]) + intercept
    slope, offset = _curve(z, y, np.where(y == 1, weigh[1], weigh[0]))
    return replace(model, weights=weights, intercept=intercept, slope=slope, offset=offset)


def _curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y on z, by Newton steps with smoothed targets; rows weigh ``weight``."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mid, wide = z.mean(), max(z.std(), 1e-6)
    x = np.stack([(z - mid) / wide, np.ones_like(z)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g, h = x.T @ (weight * (p - t)), (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / wide), float(w[1] - w[0] * mid / wide)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Append the struct ``out`` (``RESULT``): the classifier's calibrated score, the vote pattern, the label model's posterior of that pattern."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, reader = shared.value, Reader(shared.value)

        def run(c: pa.Array) -> pa.Array:
            got = [reader.read(t.as_py()) for t in c]
            if m.constant is not None:
                s = np.full(len(got), m.constant)
            else:
                z = np.array([m.weights[x].sum() for _, x in got]) + m.intercept
                s = 1 / (1 + np.exp(-np.clip(m.slope * z + m.offset, -30, 30)))
            votes = np.array([v for v, _ in got], np.int32)
            return pa.StructArray.from_arrays([pa.array(s), pa.array(votes), pa.array(m.posterior[votes])], names=["score", "votes", "posterior"])

        return run

    return append_column(docs, [text_col], out, RESULT, make)
