"""Language ID: each document is a mixture of languages, fitted by expectation-maximisation over its n-grams.

``fit`` counts letter n-grams (hashed to a fixed number of buckets) for each language in labelled documents;
``classify`` finds the language proportions of every document by EM over the n-gram likelihoods and then the set of
languages whose likelihood, less a penalty for each language, is largest.

The model has ``languages x BUCKETS`` numbers at any corpus size. ``fit`` reads a hash sample of about
``rows_per_language`` labelled documents a language (a documented bound); classification is one pass without a shuffle.

Edge cases: null text or text without a letter is ``und`` with score 0; very long texts are read whole; languages tie in
alphabetical order; with no labelled row at all every document is ``und``; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import append_column, arrow_type

BUCKETS = 1 << 14
UNKNOWN = "und"
#: By byte and place in the n-gram: its part of a multiplicative 32-bit hash, whose top bits are the bucket.
_FIRST, _SECOND, _THIRD = (((np.arange(256, dtype=np.uint64) << np.uint64(s)) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for s in (16, 8, 0))
RESULT = "lang STRING, score DOUBLE, languages ARRAY<STRUCT<lang: STRING, share: DOUBLE>>, fit DOUBLE"
#: A-Z to a-z, bytes below 0x80 that are no letters to blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def ngram_buckets(text: str) -> np.ndarray:
    """Counts of the bucketed letter 3-grams of a text (UTF-8 bytes, lower case, words set off by one blank)."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    return np.bincount((_FIRST[b[:-2]] + _SECOND[b[1:-1]] + _THIRD[b[2:]]) >> 18, minlength=BUCKETS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """``p[g, l]``: the probability of bucket g in language l; ``log`` its logarithm."""

    languages: tuple[str, ...]
    p: np.ndarray
    log: np.ndarray


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep: Column | None = None, rows_per_language: int = 3000, smoothing: float = 0.3) -> Model:
    """Learn n-gram probabilities from about ``rows_per_language`` documents of each language, the ones whose hash falls lowest.

    Documents without text or language, and those that ``keep`` excludes, don't count.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if keep is None else keep))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros((BUCKETS, 0)))
    index, cap = {x: i for i, x in enumerate(languages)}, rows_per_language
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // cap))))
    sample = rows.where(F.pmod(F.xxhash64(id_col, F.lit(5)), share[F.col(lang_col)]) == 0).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[index[lang]] += ngram_buckets(text.as_py())
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["cell", "n"])

    cells = sample.mapInArrow(count, "cell LONG, n LONG").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(languages) * BUCKETS)
    total[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    total = total.reshape(len(languages), BUCKETS) + smoothing
    p = np.ascontiguousarray((total / total.sum(1, keepdims=True)).T)
    return Model(languages, p, np.log(p))


def _em(p: np.ndarray, c: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` in counts ``c``, and the log-likelihood."""
    share = start
    part = c / c.sum()
    for _ in range(steps):
        new = share * ((part / (p @ share)) @ p)
        moved, share = max(map(abs, (new - share).tolist())), new
        if moved < 1e-3:
            break
    return share, float(c @ np.log(p @ share))


def mixture(model: Model, text: str, *, penalty: float = 6.0, steps: int = 25) -> tuple[str, float, list[tuple[str, float]], float]:
    """(language, its share, the chosen languages with shares, bits an n-gram better than chance) of a text with a letter.

    The penalty for each further language is ``penalty * log(n-grams) / 2``: overlapping n-grams repeat evidence, so it is a
    multiple of the usual one.
    """
    counts = ngram_buckets(text)
    at = np.flatnonzero(counts)
    c, p = counts[at].astype(np.float64), model.p[at]
    price, some = penalty * np.log(max(2.0, c.sum())) / 2, len(model.languages)
    alone = c @ model.log[at]
    best = int(alone.argmax())
    start = np.full(some, 0.1 / max(1, some - 1))
    start[best] = 0.9 if some > 1 else 1.0
    share, full = _em(p, c, start, steps)
    chosen, value, shares = [best], alone[best], np.array([1.0])
    if some > 1 and full - value > price:  # else no set can repay the price
        order = np.argsort(-share, kind="stable")
        for k in range(2, len(model.languages) + 1):
            some = np.sort(order[:k])
            s, ll = _em(p[:, some], c, np.full(k, 1 / k), 2 * steps)
            if ll - price * (k - 1) <= value - price * (len(chosen) - 1):
                break
            chosen, value, shares = some.tolist(), ll, s
    top = int(shares.argmax())
    pairs = sorted(zip((model.languages[i] for i in chosen), shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    # of a single language, the share that the free mixture gives it says how sure that is
    score = float(shares[top]) if len(chosen) > 1 else float(max(share[best], 0.5))
    return model.languages[chosen[top]], min(1.0, score), pairs, float(value / c.sum() / np.log(2) + np.log2(BUCKETS))


def classify(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "language", penalty: float = 6.0) -> DataFrame:
    """Append the struct ``out`` (``RESULT``): language, score, the languages with their shares, fit in bits an n-gram."""
    shared, arrow = docs.sparkSession.sparkContext.broadcast(model), arrow_type(RESULT)

    def make():
        known = shared.value

        def one(text: str | None) -> dict:
            if not known.languages or not has_letter(text):
                return {"lang": UNKNOWN, "score": 0.0, "languages": [], "fit": 0.0}
            lang, score, pairs, fits = mixture(known, text, penalty=penalty)
            return {"lang": lang, "score": score, "languages": [{"lang": a, "share": s} for a, s in pairs], "fit": fits}

        return lambda c: pa.array([one(x.as_py()) for x in c], arrow)

    return append_column(docs, [text_col], out, RESULT, make)
