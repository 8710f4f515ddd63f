"""Words of texts without blanks: the cheapest path through the matches of a dictionary, and tokens with phrases.

A word costs minus the logarithm of its share, in whole millionths, so sums are exact. The dictionary is a bounded table (``most_words``) that goes to
the tasks as a trie; texts stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a character costs that no word of the dictionary covers: rarer than once in 480 million.
UNKNOWN = 20_000_000
HAN = "[\\u4e00-\\u9fa5]"


def word_costs(words: DataFrame) -> DataFrame:
    """(word, cost) of (word, n): minus the logarithm of n's share of all, in millionths."""
    counted = words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("word", F.round(-F.log(F.col("n") / F.col("total")) * 1_000_000).cast("long").alias("cost"))


def trie(words: list[tuple[str, int]]) -> dict:
    """Nested by character; under the empty string a node holds the cost of the word that ends there."""
    top: dict = {}
    for word, cost in words:
        node = top
        for c in word:
            node = node.setdefault(c, {})
        node[""] = min(cost, node.get("", cost))
    return top


def best_path(run: str, top: dict, unknown: int = UNKNOWN) -> tuple[list[str], int]:
    """(words, cost) of the cheapest way through a run without blanks; of equal ones, the one with the longer first word.

    ASCII letters and digits that no word covers stay together as one word.
    """
    n = len(run)
    cost, step = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        cost[i], step[i] = cost[i + 1] + unknown, -1
        node, j = top, i
        while j < n and (node := node.get(run[j])) is not None:
            j += 1
            if "" in node and cost[j] + node[""] <= cost[i]:
                cost[i], step[i] = cost[j] + node[""], j - i
    words, i, loose = [], 0, False
    while i < n:
        size = abs(step[i])
        single = step[i] == -1 and run[i].isascii() and run[i].isalnum()
        if single and loose:
            words[-1] += run[i]
        else:
            words.append(run[i : i + size])
        loose, i = single, i + size
    return words, cost[0]


def segmented(texts: DataFrame, costs: DataFrame, *, id_col: str, text_col: str, most_words: int = 2_000_000) -> DataFrame:
    """(id, words, cost): the words of whole texts, blanks between them aside. An empty or null text has none, at no cost."""
    known = costs.select("word", "cost").where(F.length("word") > 0)
    if (n := known.count()) > most_words:
        raise ValueError(f"the dictionary has {n} words; at most {most_words} go to the tasks")
    table = known.toArrow()
    shared = texts.sparkSession.sparkContext.broadcast(trie(list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))))
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for b in batches:
            words, costs = [], []
            for text in b.column(1).to_pylist():
                parts = [best_path(piece, top) for piece in (text or "").split()]
                words.append([w for ws, _ in parts for w in ws])
                costs.append(sum(c for _, c in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string())), pa.array(costs, pa.int64())], names=["id", "words", "cost"])

    return texts.select(id_col, text_col).mapInArrow(run, f"id {kind}, words ARRAY<STRING>, cost LONG")


def content_words(words: Column, stop: list[str]) -> Column:
    """Words of two or more Han characters that aren't stop words."""
    return F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike(f"^{HAN}+$") & ~w.isin(stop))


def phrase_tokens(text: Column, phrases: list[str], stop: list[str]) -> Column:
    """Tokens of a text in Latin letters: known phrases whole, the longest first; words of three letters or more that aren't stop words.

    A word loses a possessive ending. Capitals stay, except in words of capitals alone.
    """
    named = "|".join(re.escape(p) for p in sorted({p for p in phrases if " " in p}, key=lambda p: (-len(p), p)))
    word = r"\p{L}[\p{L}’'-]+"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({named}|{word})" if named else f"({word})"), 1)

    def shaped(w: Column) -> Column:
        bare = F.regexp_replace(w, "[’'][sS]$", "")
        return F.when(w.contains(" "), w).when(w.rlike(r"^\p{Lu}") & (w != F.upper(w)), bare).otherwise(F.lower(bare))

    return F.filter(F.transform(found, shaped), lambda w: w.contains(" ") | ((F.length(w) >= 3) & ~F.lower(w).isin(stop)))
