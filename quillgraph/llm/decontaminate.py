"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents, verified exactly.

A window is ``window`` consecutive words of an item (an item with fewer words, but not none, is one window). Its shingles are
its words. They are ordered by rarity: the number of documents that contain them, counted over all documents. A document
stretch that contains all of a window's shingles contains its rarest one, so a prefix of one shingle is enough: document
words are joined with the rarest word of each window, then a length bound (the document has room for the window) and a
positional bound (the stretch that puts the rarest word at its place in the window lies in the document) hold before the
words are compared.

The benchmark side is a query set, taken in blocks of at most ``block_windows`` distinct windows; a block is broadcast, which
bounds its size, and joined with all documents without shuffling them, so no word, passage or source can make a hot task.

Edge cases: null or empty texts have no words and no hits; null item ids are left out; items with one id are one item;
repeated rows each get their result; without benchmark windows no word is hit; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import append_column, arrow_type, words

RESULT = "n_words LONG, spans ARRAY<STRUCT<first: LONG, past: LONG>>, items ARRAY<STRING>"


def windows(text: bytes | None, size: int) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def item_windows(benchmark: DataFrame, *, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window, items): the distinct windows as blank-joined words, with the sorted ids of the items that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = sorted({b" ".join(w) for w in windows(text.as_py(), window)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "window BINARY, item STRING").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def document_counts(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a (bounded) vocabulary stands."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0):
                count.update(known.value.intersection(words(text.as_py())))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word BINARY, n LONG").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def prefix_index(block: list[tuple[bytes, list[str]]], rarity: dict[bytes, int]) -> dict[bytes, list[tuple[int, list[bytes], list[str]]]]:
    """Rarest word of a window -> (its place in the window, the window's words, its items); ties by word, then by place."""
    index: dict[bytes, list[tuple[int, list[bytes], list[str]]]] = {}
    for text, items in block:
        w = text.split()
        at = min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i))
        if rarity.get(w[at]):  # a word that no document has rules its windows out
            index.setdefault(w[at], []).append((at, w, items))
    return index


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], past)
        else:
            out.append((first, past))
    return out


def find(w: list[bytes], index: dict[bytes, list[tuple[int, list[bytes], list[str]]]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of the words that occurring windows cover, and the ids of their items."""
    spans, items = [], set()
    for i, x in enumerate(w):
        if x in index:
            for at, window, owners in index[x]:
                first, past = i - at, i - at + len(window)
                if first >= 0 and past <= len(w) and w[first:past] == window:
                    spans.append((first, past))
                    items.update(owners)
    return merged(spans), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_windows: int = 200_000, out: str = "leaks") -> DataFrame:
    """Append the struct ``out`` (``RESULT``): the word count, the merged spans of hit words, the sorted ids of leaked items."""
    from ._common import free_name

    arrow, sc = arrow_type(RESULT), docs.sparkSession.sparkContext
    known = item_windows(benchmark, id_col=item_col, text_col=item_text_col, window=window)
    blocks = max(1, -(-known.count() // block_windows))
    result, before = docs, None
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).toArrow()
        block = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        rarity = document_counts(docs, text_col, {w for text, _ in block for w in text.split()})
        shared = sc.broadcast(prefix_index(block, rarity))

        def make(shared=shared):
            index = shared.value
            keys = index.keys()

            def run(texts: pa.Array, earlier: pa.Array | None = None) -> pa.Array:
                rows = []
                for i, text in enumerate(texts.cast(pa.binary())):
                    w = words(text.as_py())
                    spans, items = find(w, index) if not keys.isdisjoint(w) else ([], set())
                    if earlier is not None and (old := earlier[i].as_py())["items"]:
                        spans, items = merged([*spans, *((s["first"], s["past"]) for s in old["spans"])]), items.union(old["items"])
                    rows.append({"n_words": len(w), "spans": [{"first": a, "past": b} for a, b in spans], "items": sorted(items)})
                return pa.array(rows, arrow)

            return run

        name = out if k == blocks - 1 else free_name(result, f"leaks_{k}")
        result = append_column(result, [text_col] + [before] * (before is not None), name, RESULT, make)
        result, before = (result.drop(before) if before else result), name
    return result
