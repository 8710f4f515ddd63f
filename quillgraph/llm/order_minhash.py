"""MinHash near-dedup by Order MinHash: sketches that keep text order, candidates verified by banded alignment.

A document's items are its words (``k`` = 1) or runs of ``k`` words, labelled with their occurrence, so each item is unique in
its document. A sketch takes the ``ell`` items with the smallest hashes of one random order and hashes them in text order: two
documents agree in it if they share these items and their order, which follows their edit similarity.

Similarity is that of an alignment of the words: the longest common subsequence over all words of the two texts,
``lcs / (n + m - lcs)``, at least ``threshold``. So a text with one word in ten replaced is a near copy (9 / 11), which
runs of five words would put at about 0.4. Words are compared by 32-bit hashes. The alignment is banded: in one that reaches
the threshold no word moves further than ``max(n, m) - lcs`` places, so matches beyond that aren't looked at.

Three kinds of sketch share the work, by the length of the texts; a pair has one of them in common at any length:

* from ``least_long`` words on, ``sketches`` sketches of ``ell`` words (a pair at 0.8 agrees in one with probability 0.17);
* ``12`` to ``SHORT`` words, ``short_sketches`` of ``short_ell`` words (0.4 and more), since ``ell`` words are most of such a text;
* up to ``TINY`` words, all that is left of the text once up to a fifth of its words is dropped: exact.

Plan: equal word sequences become one node. Each node is verified against one other, the lowest-hashed node of its buckets
(the nodes of one sketch value), so most of a group of copies is linked by one comparison a node; then the nodes of each bucket
against one of them, a different one in each bucket, unless both are in one class already, which no further link would
change. Where a bucket still has several components, the nodes outside its main one are compared with all others of
the bucket, in blocks of both: marks of their occurrence-labelled words bound what two texts can share, and what passes is aligned, the
likeliest partner of a node first, then, in blocks of nodes again, all whose nodes are still apart. Connected components are found by
contraction. No bucket is gathered in one task, and nothing is capped. What the sketches don't see
(a pair that agrees in none of them) isn't linked: by the figures above under one pair in 200 at 0.8, far fewer above it.

Edge cases: a null text is a class of its own, texts without a word are one only with equal texts; repeated rows have equal
classes; a class is named by its smallest id, ties don't arise; rows without id are in classes like any other, which are
named null if no row has an id; very long texts are read whole and aligned in blocks of rows; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, give_back, mix, stored, word_hashes

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Items hashed at a time, nodes a block of the comparison within buckets, and rows a block of an alignment.
CHUNK, BLOCK, ROWS = 1 << 15, 256, 512
#: Bits of a node's marks.
MARKS = 4096
#: Most words of short and of tiny texts.
SHORT, TINY = 64, 14


def items(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the occurrence-labelled runs of k word hashes, in text order; one for fewer words; none without words."""
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    run = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        run = run * _GOLD + w[j : j + n]
    run = mix(run)
    order = np.argsort(run, kind="stable")
    new = np.concatenate([[True], run[order[1:]] != run[order[:-1]]])
    if not new.all():  # label the second, third ... occurrence
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        label = np.zeros(n, np.uint64)
        label[order] = (np.arange(n) - first).astype(np.uint64)
        run = np.where(label > 0, mix(run + label * _GOLD), run)
    return run


def sketch(h: np.ndarray, seeds: np.ndarray, ell: int) -> np.ndarray:
    """One hash for each (odd) seed: of the ell items that come first in the seed's order, in text order."""
    if len(h) <= ell:
        at = np.tile(np.arange(len(h)), (len(seeds), 1))
    elif len(h) <= CHUNK:
        at = _least(h * seeds[:, None], ell)
    else:
        parts = [np.arange(start, min(len(h), start + CHUNK)) for start in range(0, len(h), CHUNK)]
        at = np.hstack([part[_least(h[part] * seeds[:, None], ell)] for part in parts])
        at = np.take_along_axis(at, _least(h[at] * seeds[:, None], ell), 1)
    out = seeds.copy()
    for j in range(at.shape[1]):
        out = out * _GOLD + h[at[:, j]]
    return mix(out).view(np.int64)


def _least(v: np.ndarray, ell: int) -> np.ndarray:
    """The places, rising, of the ell least values of each row."""
    if v.shape[1] <= ell:
        return np.tile(np.arange(v.shape[1]), (len(v), 1))
    at = np.flatnonzero(v <= np.partition(v, ell - 1, axis=1)[:, ell - 1 : ell])
    if len(at) != len(v) * ell:  # equal values: two items share a hash
        return np.sort(np.argpartition(v, ell - 1, axis=1)[:, :ell], axis=1)
    return at.reshape(len(v), ell) % v.shape[1]


def leftovers(w: np.ndarray, threshold: float) -> np.ndarray:
    """Hashes of what is left of the words once up to ``1 - threshold`` of them are dropped; texts that reach the threshold share one."""
    n = len(w)
    kept = [at for drop in range(int((1 - threshold) * n + 1e-9) + 1) for at in combinations(range(n), n - drop)]
    out = []
    for size in sorted({len(at) for at in kept}):
        x = np.full(sum(len(at) == size for at in kept), size, np.uint64)
        for column in w[np.array([at for at in kept if len(at) == size])].T:
            x = x * _GOLD + column
        out.append(mix(x))
    return np.unique(np.concatenate(out)).view(np.int64)


class Sketches:
    """The bucket values of a text's word hashes: one array of all its sketches."""

    def __init__(self, k: int, ell: int, sketches: int, short_ell: int, short_sketches: int, threshold: float, seed: int) -> None:
        seeds = np.random.default_rng(seed).integers(1, 1 << 63, sketches + short_sketches).astype(np.uint64) | np.uint64(1)
        self.k, self.ell, self.short_ell, self.threshold = k, ell, short_ell, threshold
        self.seeds, self.short_seeds = seeds[:sketches], seeds[sketches:]
        # a text with one word more than a short (tiny) one is near no text below this
        self.least_long, self.least_short = (int(np.ceil(threshold * (x + 1) - 1e-9)) for x in (SHORT, TINY))

    def of(self, w: np.ndarray, single: np.ndarray | None = None) -> np.ndarray:
        """The sketches of word hashes; ``single`` are their items of one word, if known."""
        n, h, found = len(w), items(w, self.k) if single is None or self.k != 1 else single, []
        if n >= self.least_long:
            found.append(sketch(h, self.seeds, self.ell))
        if self.least_short <= n <= SHORT:
            found.append(sketch(h, self.short_seeds, self.short_ell))
        if 0 < n <= TINY:
            found.append(leftovers(w, self.threshold))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def marks(h: np.ndarray) -> bytes:
    """A bit for each of ``MARKS`` hash classes in which one of the items (occurrence-labelled words) falls."""
    bits = np.zeros(MARKS, bool)
    bits[(h >> np.uint64(20)).astype(np.int64) % MARKS] = True
    return np.packbits(bits).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """An upper bound of the items that texts of n and m items share, by their marks (rows of 64-bit numbers).

    Each class that only one of them has holds an item of its that the other lacks.
    """
    return np.minimum(n - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))


def codes(w: np.ndarray) -> np.ndarray:
    """The words as 32-bit hashes: what is aligned."""
    return (w >> np.uint64(32)).astype(np.uint32)


def banded_lcs(x: list[int], y: list[int], ahead: int, back: int) -> int:
    """Longest common subsequence, over all matches x[i] = y[j] with ``j - back <= i <= j + ahead`` at least.

    Bit-parallel: the places of x within the band are the bits of a number, in which those not gained so far are set; each
    word of y takes a few operations on it. The band moves on by ``ROWS`` words at a time, so a number has about
    ``ROWS + ahead + back`` bits.
    """
    places: dict[int, list[int]] = {}
    for i, word in enumerate(x):
        places.setdefault(word, []).append(i)
    open_bits, base, top, gained = 0, 0, 0, 0
    for j in range(0, len(y), ROWS):
        lo, hi = min(max(base, j - back), len(x)), min(len(x), j + ROWS + ahead)
        gone = min(lo, top) - base  # places that leave the band
        gained += gone - (open_bits & (1 << gone) - 1).bit_count()
        open_bits >>= gone
        base, hi = lo, max(hi, lo)
        top = max(top, base)
        open_bits |= (1 << hi - top) - 1 << top - base
        top, full, known = hi, (1 << hi - base) - 1, {}
        for word in y[j : j + ROWS]:
            mask = known.get(word)
            if mask is None:
                at = places.get(word, ())
                at = at[bisect_left(at, base) : bisect_left(at, top)] if len(at) else at
                if len(at) > 64:
                    bits = np.zeros(top - base, bool)
                    bits[np.array(at) - base] = True
                    mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
                else:
                    mask = 0
                    for i in at:
                        mask |= 1 << i - base
                known[word] = mask
            if mask:
                hit = open_bits & mask
                open_bits = (open_bits + hit | open_bits - hit) & full
    return gained + top - base - open_bits.bit_count()


def alignment(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two word sequences (32-bit codes) by their banded alignment; 0 if it can't reach the threshold."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m) - 1e-9:
        return 0.0
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    some = min(n, m)
    apart = np.flatnonzero(a[:some] != b[:some])
    head = int(apart[0]) if len(apart) else some  # equal words at the start, then at the end
    apart = np.flatnonzero(a[n - some + head :][::-1] != b[m - some + head :][::-1])
    tail = int(apart[0]) if len(apart) else some - head
    x, y = a[head : n - tail], b[head : m - tail]
    lcs = head + tail
    if len(x) and len(y):
        one, other = (items(v.astype(np.uint64), 1) for v in (x, y))
        if lcs + len(np.intersect1d(one, other, assume_unique=True)) < need:
            return 0.0
        lcs += banded_lcs(x.tolist(), y.tolist(), max(0, n - need), max(0, m - need))
    return lcs / (n + m - lcs) if lcs >= need else 0.0


def node_key(text: bytes | None, w: np.ndarray) -> bytes | None:
    """Names a sequence of word hashes, or a text without words; None for no text."""
    if text is None:
        return None
    return hashlib.md5(w.tobytes() if len(w) else b"\x00" + text, usedforsecurity=False).digest()


def sketched(docs: DataFrame, sketches: Sketches, *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, n, sketch, marks): node names equal word sequences; n words; sketch is empty for texts without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            rows = []
            for text in b.column(1):
                t = text.as_py()
                w = word_hashes(t)
                key = node_key(t, w)
                if key is None or key not in seen:
                    if len(seen) > 2000:
                        seen.clear()
                    single = items(w, 1)
                    seen[key] = len(w), sketches.of(w, single), marks(single)
                rows.append((key, *seen[key]))
            flat = np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows)])
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), values, pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "node", "n", "sketch", "marks"])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, node BINARY, n LONG, sketch ARRAY<LONG>, marks BINARY")


def node_words(docs: DataFrame, needed: DataFrame, *, text_col: str) -> DataFrame:
    """(node, words): the word codes of each node in ``needed``, stored; the only shuffle of texts."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for text in b.column(0):
                w = word_hashes(text.as_py())
                if len(w):
                    keys.append(node_key(b"", w))
                    found.append(codes(w).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["node", "words"])
        give_back()

    texts = docs.select(F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL").mapInArrow(keyed, "node BINARY, words BINARY")
    return stored(texts.join(needed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "omh-words")


def verified(words: DataFrame, pairs: DataFrame, *, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of nodes that reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for x, y, wx, wy in zip(a, b, batch.column(2), batch.column(3), strict=True):
                s = alignment(np.frombuffer(wx.as_buffer(), np.uint32), np.frombuffer(wy.as_buffer(), np.uint32), threshold)
                if s:
                    keep.append((x, y, s))
            if keep:
                c = list(zip(*keep, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.float64())], names=["a", "b", "similarity"])
        give_back()

    joined = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    return joined.select("a", "b", "wa", "wb").mapInArrow(compare, "a BINARY, b BINARY, similarity DOUBLE")


def verified_in_blocks(words: DataFrame, pairs: DataFrame, *, threshold: float) -> DataFrame:
    """(a, b, similarity) of links that join what the pairs (a, b) that reach the threshold join, for many pairs of few nodes.

    Nodes are dealt to blocks by hash, and the words of a node go once to each pair of blocks that has pairs of it, not once to each
    pair. Every pair is aligned, but for those whose nodes earlier links of their blocks have joined already.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    blocks = max(1, -(-nodes.count() // BLOCK))
    keyed = pairs.select("a", "b", *(F.pmod(F.xxhash64(x, F.lit(43)), F.lit(blocks)).alias("b" + x) for x in "ab"))
    needed = keyed.select(F.col("a").alias("node"), F.col("ba").alias("ka"), F.col("bb").alias("kb")).union(keyed.select("b", "ba", "bb")).distinct()

    def compare(known: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        own = {n: np.frombuffer(w, np.uint32) for n, w in zip(known["node"], known["words"], strict=True)}
        leader: dict = {}

        def lead(x: bytes) -> bytes:
            while (up := leader.get(x, x)) != x:
                leader[x] = x = leader.get(up, up)
            return x

        keep = []
        for x, y in zip(some["a"], some["b"], strict=True):
            one, other = lead(x), lead(y)
            if one != other and (s := alignment(own[x], own[y], threshold)):
                leader[one] = other
                keep.append((x, y, s))
        return pd.DataFrame(keep, columns=["a", "b", "similarity"])

    sent = needed.join(words, "node")
    return sent.groupBy("ka", "kb").cogroup(keyed.groupBy("ba", "bb")).applyInPandas(compare, "a BINARY, b BINARY, similarity DOUBLE")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): one node of each connected component names it.

    By contraction: every node points at its smallest neighbour, pointers are followed four steps, and the links are carried
    over to where their ends point; those within one node go. So the links shrink in each round, which is written to the
    shared folder, until none is left.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "omh-links")
    labels = None
    while labels is None or edges.limit(1).count():
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        points = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
        for _ in range(2):
            points = relabelled(points, points)
        points = stored(points, "omh-points")
        labels = points if labels is None else relabelled(labels, points)
        one, other = (points.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "ab")
        moved = edges.join(one, "a").join(other, "b").where("ca <> cb")
        edges = stored(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "omh-links")
    return stored(labels, "omh-labels")


def relabelled(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(node, component): ``labels`` with the components that are nodes of ``names`` replaced by theirs."""
    new = names.select(F.col("node").alias("component"), F.col("component").alias("renamed"))
    return labels.join(new, "component", "left").select("node", F.coalesce("renamed", "component").alias("component"))


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components once ``links`` (a, b) join those of ``labels``."""
    one, other = (labels.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    between_components = links.select("a", "b").join(one, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    names = components(between_components)
    return stored(relabelled(labels, names).union(names.join(labels, "node", "left_anti").select("node", "component")), "omh-labels")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 1, ell: int = 8, sketches: int = 32, short_ell: int = 4, short_sketches: int = 24, threshold: float = 0.8, seed: int = 23
) -> DataFrame:
    """(doc_id, class_id, class_size, class_texts) of every row.

    class_id is the smallest id among the documents it is linked with, directly or not; class_size counts the rows of the
    class, class_texts its different texts (word sequences).
    """
    bounded_batches(docs.sparkSession)
    known = stored(sketched(docs, Sketches(k, ell, sketches, short_ell, short_sketches, threshold, seed), id_col=id_col, text_col=text_col), "omh-sketches")
    nodes = known.where("n > 0").dropDuplicates(["node"]).select("node", "n", "sketch", "marks")
    entries = nodes.select("node", "n", F.explode("sketch").alias("value"))
    order = F.xxhash64("node", "value")
    lowest = F.min(F.struct("node", "n")).alias("lowest")  # names are hashes, so this is any node
    heads = entries.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct(order.alias("order"), "node", "n")).alias("head"), lowest).where("size > 1")
    members = stored(entries.join(heads, "value").select("value", "node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"), "lowest"), "omh-buckets")
    words = node_words(docs, members, text_col=text_col)

    def fits(other: str) -> Column:
        return F.least("n", other) >= threshold * F.greatest("n", other) - 1e-9

    first = members.where((F.col("node") != F.col("lowest.node")) & fits("lowest.n")).groupBy(F.col("node").alias("a")).agg(F.min("lowest.node").alias("b"))
    labels = components(verified(words, first, threshold=threshold))
    pairs = members.where((F.col("node") != F.col("head")) & fits("head_n")).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    labels = with_links(labels, stored(verified(words, between(pairs, labels), threshold=threshold), "omh-verified"))
    rest = stored(unsettled(members, labels, nodes, threshold), "omh-rest")
    # the likeliest partners first: once one of them links two components, what else lies between them needs no look
    for first_look in (True, False):
        if not rest.limit(1).count():
            break
        some = likeliest(rest) if first_look else rest
        check = verified if first_look else verified_in_blocks
        labels = with_links(labels, stored(check(words, unordered(some), threshold=threshold), "omh-more"))
        if first_look:
            rest = stored(between(rest.join(some, ["a", "b"], "left_anti"), labels, "same"), "omh-rest")
    grouped = known.select("doc_id", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = grouped.where(F.col("component").isNotNull()).groupBy("component", "node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    names = classes.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("class_texts"))
    one = F.lit(1).cast("long")
    return grouped.join(names, "component", "left").select(
        "doc_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", one).alias("class_size"), F.coalesce("class_texts", one).alias("class_texts")
    )


def likeliest(pairs: DataFrame) -> DataFrame:
    """(a, b): for each a the pair that agrees in most sketches."""
    return pairs.groupBy("a").agg(F.max(F.struct("same", "b"))["b"].alias("b"))


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def between(pairs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) whose nodes aren't in one component."""
    one, other = (labels.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    return pairs.join(one, "a", "left").join(other, "b", "left").where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b", *columns)


def unsettled(members: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, same): pairs from buckets with several components, a outside the bucket's main one; ``same`` is in how many of these buckets they meet.

    A bucket is dealt into blocks of nodes by hash; each group of the comparison holds one block of probes and one of targets.
    A pair is given only if the words that the marks let its nodes share could be enough for the threshold.
    """
    # a node without a link is a component of its own
    own = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    share = own.groupBy("value", "component").agg(F.count("*").alias("c"))
    main = share.groupBy("value").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("c").alias("all"), F.max("c").alias("most"))
    mixed = main.where("parts > 1").select("value", "main", F.ceil(F.col("all") / BLOCK).alias("tb"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("pb"))
    rows = own.select("value", "node", "n", "component").join(mixed, "value")
    rows = stored(rows.join(nodes.select("node", "marks"), "node"), "omh-mixed")
    spread = F.abs(F.xxhash64("node", F.lit(41)))
    columns = ["value", "node", "n", "component", "marks"]
    targets = rows.select(*columns, F.lit(False).alias("probe"), (spread % F.col("tb")).alias("t"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("p"))
    probes = rows.where("component <> main").select(*columns, F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("t"), (spread % F.col("pb")).alias("p"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        probe, target = group[group["probe"]], group[~group["probe"]]
        if not len(probe) or not len(target):
            return pd.DataFrame({"a": [], "b": []})
        n, m = probe["n"].to_numpy()[:, None], target["n"].to_numpy()[None, :]
        good = (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (probe["component"].to_numpy()[:, None] != target["component"].to_numpy()[None, :])
        i, j = np.nonzero(good)
        x, y = (np.frombuffer(b"".join(side["marks"]), np.uint64).reshape(-1, MARKS // 64) for side in (probe, target))
        found = []
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            bound = most_shared(x[a], y[b], n[a, 0], m[0, b])
            can = bound >= threshold * (n[a, 0] + m[0, b] - bound) - 1e-6
            found.append((a[can], b[can]))
        i, j = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, int) for s in (0, 1))
        return pd.DataFrame({"a": probe["node"].to_numpy()[i], "b": target["node"].to_numpy()[j]})

    found = targets.unionByName(probes).groupBy("value", "t", "p").applyInPandas(meet, "a BINARY, b BINARY")
    return found.groupBy("a", "b").agg(F.count("*").alias("same"))
