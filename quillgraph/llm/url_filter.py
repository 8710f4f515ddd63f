"""URL filters: rules by host and path, then the ratio of two character language models.

``split_url`` and ``match_rules`` are column expressions. Where no rule fits, two smoothed variable-order Markov models,
one of the URLs that rules accept and one of those they block, decide by the calibrated length-normalised difference of
log-likelihoods.

Orders 0 to ``ORDER`` are interpolated by Witten-Bell smoothing over an alphabet of ``ALPHABET`` symbols, so the tables
have at most ``2 * ALPHABET ** (ORDER + 1)`` counts at any corpus size; they are counted over all URLs that a rule decides.
The calibration is a logistic curve through a histogram of the scores with a fixed number of bins.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule, and is scored as an empty string,
which is no evidence: allow; a very long URL is read whole, repeated rows get equal verdicts, an empty table gives no rows. If accepted or blocked examples are missing, the method allows all. Of rules of equal length
the first in (block, allow), then alphabetical order, wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import append_column

ORDER, ALPHABET, BINS, SPAN = 3, 40, 2000, 8.0
#: Symbols of their own; all digits are one symbol, all other bytes the last one. 0 is the start and end of a URL.
SYMBOLS = b"abcdefghijklmnopqrstuvwxyz/.-_?=&%#:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Columns host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return host, path


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Columns rule and its verdict: the longest rule whose host is the URL's or above it, and whose path starts the URL's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]), reverse=True):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _symbol_table() -> np.ndarray:
    table = np.full(256, ALPHABET - 1, np.int64)
    for i, b in enumerate(SYMBOLS):
        table[b] = i + 1
    table[np.arange(48, 58)] = len(SYMBOLS) + 1
    table[np.arange(65, 91)] = table[np.arange(97, 123)]
    return table


_TABLE = _symbol_table()


def ngram_codes(url: str | None) -> list[np.ndarray]:
    """For orders 0 to ORDER, the code (context and symbol) at each symbol of the URL and at its end; empty for no text."""
    if not url:
        return [np.zeros(0, np.int64)] * (ORDER + 1)
    s = _TABLE[np.frombuffer(url.encode("utf-8", "replace"), np.uint8)]
    s = np.concatenate([np.zeros(ORDER, np.int64), s, [0]])
    n, out, code, scale = len(s) - ORDER, [], 0, 1
    for k in range(ORDER + 1):
        code = s[ORDER - k : ORDER - k + n] * scale + code
        scale *= ALPHABET
        out.append(code)
    return out


@dataclass(frozen=True)
class Model:
    """``logs[c]``: the interpolated log-probability, in class c, of a symbol after its ORDER symbols; slope and offset of the calibration."""

    logs: tuple[np.ndarray, np.ndarray] | None
    slope: float = 1.0
    offset: float = 0.0


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolation of orders 0 to ORDER from the counts of the longest contexts; as logarithms, flat."""
    full = counts.astype(np.float64)
    p = np.full(ALPHABET, 1 / ALPHABET)
    for k in range(ORDER + 1):
        # axes: (symbol, previous, the one before, ...) from least to most significant digit of the code
        c = full.reshape(-1, ALPHABET ** (k + 1)).sum(0).reshape(-1, ALPHABET)  # contexts x symbols
        n, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        below = np.tile(p.reshape(-1, ALPHABET), (len(c) // max(1, p.size // ALPHABET), 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (c + kinds * below) / (n + kinds)
        p = np.where(n > 0, mixed, below).ravel()
    return np.log(p).astype(np.float32)


def score(model: Model, url: str | None) -> float:
    """Length-normalised log-likelihood difference, accepted less rejected; 0 for no text or no model."""
    if model.logs is None or not url:
        return 0.0
    at = ngram_codes(url)[ORDER]
    return float((model.logs[0][at] - model.logs[1][at]).mean())


def fit(urls: DataFrame, *, url_col: str = "url", verdict_col: str = "verdict") -> Model:
    """Both models from all rows whose verdict is allow or block; calibrated with classes weighing alike.

    URLs are dealt to two folds by hash. Those of one are scored, for the calibration only, by models counted on the other, so
    no URL is judged by a model that has seen it; the models that are returned count all.
    """
    kind = (F.col(verdict_col) == "block").cast("int").alias("c")
    rows = urls.where(F.col(verdict_col).isin("allow", "block") & F.col(url_col).isNotNull()).select((kind + 2 * F.pmod(F.xxhash64(F.col(url_col), F.lit(13)), F.lit(2)).cast("int")).alias("c"), F.col(url_col).alias("url"))
    size = ALPHABET ** (ORDER + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            found = [ngram_codes(u)[ORDER] + k * size for k, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            at, n = np.unique(np.concatenate(found), return_counts=True)
            both, back = np.unique(np.concatenate([cells[0], at]), return_inverse=True)
            cells = both, np.bincount(back, np.concatenate([cells[1], n])).astype(np.int64)
        if len(cells[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["cell", "n"])

    cells = rows.mapInArrow(count, "cell LONG, n LONG").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(4 * size, np.int64)
    counts[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    accepted, rejected, accepted2, rejected2 = counts.reshape(4, size)
    if not (accepted + accepted2).any() or not (rejected + rejected2).any():
        return Model(None)
    raw = Model((smoothed(accepted + accepted2), smoothed(rejected + rejected2)))
    # calibration: the two classes' histograms of scores, whole numbers of bins
    hist = np.zeros((2, BINS))
    for fold, other in ((0, (accepted2, rejected2)), (1, (accepted, rejected))):
        judge = Model((smoothed(other[0]), smoothed(other[1]))) if other[0].any() and other[1].any() else raw
        told = with_score(rows.where(F.floor(F.col("c") / 2) == fold), judge, url_col="url", out="s")
        found = told.select((F.col("c") % 2).alias("c"), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("s.ratio") + SPAN) * (BINS / 2 / SPAN)))).alias("bin")).groupBy("c", "bin").count().toArrow().to_pydict()
        np.add.at(hist, (np.array(found["c"], int), np.array(found["bin"], int)), np.array(found["count"], float))
    return Model(raw.logs, *logistic((np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN, hist[0] / hist[0].sum(), hist[1] / hist[1].sum()))


def logistic(x: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted scores, by Newton's method with a small ridge."""
    w, total, y = np.zeros(2), accepted + rejected, accepted
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (total * q - y) + 1e-3 * w
        h = (design * (total * q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def with_score(urls: DataFrame, model: Model, *, url_col: str = "url", out: str = "url_score") -> DataFrame:
    """Append the struct ``out``: ratio (length-normalised), accepted (the calibrated probability)."""
    kind, shared = "ratio DOUBLE, accepted DOUBLE", urls.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(c: pa.Array) -> pa.Array:
            r = np.fromiter((score(m, u) for u in c.to_pylist()), np.float64, len(c))
            q = 1 / (1 + np.exp(-np.clip(m.slope * r + m.offset, -30, 30))) if m.logs is not None else np.full(len(c), 0.5)
            q[np.fromiter((not u for u in c.to_pylist()), bool, len(c))] = 0.5
            return pa.StructArray.from_arrays([pa.array(r), pa.array(q)], names=["ratio", "accepted"])

        return run

    return append_column(urls, [url_col], out, kind, make)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, url, host, path, rule, verdict (allow or block), ratio, accepted of every row."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, said = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    model = fit(rows, url_col="url", verdict_col="said")
    scored = with_score(rows, model, url_col="url", out="s")
    own = F.when(F.col("s.accepted") >= 0.5, "allow").otherwise("block")
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), F.col("s.ratio").alias("ratio"), F.col("s.accepted").alias("accepted"))
