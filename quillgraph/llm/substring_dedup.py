"""Substring deduplication by compaction of a de Bruijn graph over words.

A window of ``window`` consecutive words is an edge from its first ``window - 1`` words to its last ``window - 1`` words. An
edge that starts in a document with a smaller id is a repeat, and the words that it covers go. Edges are judged on the input.

1. Candidate edges. An edge has a rarest gram (the least hash of its grams of ``gram`` words); equal edges have equal ones.
   Consecutive edges with the same rarest gram make one row; only rows whose gram occurs in another row too go on. A task
   tells grams that repeat within it by itself and sends one row for them, so a frequent gram costs a row a task.
2. Nonbranching stretches within a document. Consecutive candidate edges are cut where the edge's hash says so (one in
   ``cut_one_in``): every document cuts the same words at the same places. A stretch is one row with the digest of all its
   words; equal stretches are matched whole by a join, and the later ones are decided.
3. Compaction of the rest. Edges of stretches that came first, or whose stretch is nowhere else, are joined with each other. Nodes
   with one repeated edge in and one out don't branch; a join of edges with the degrees of their nodes compacts them into paths of
   consecutive source coordinates.
4. An edge is a repeat if the edge at the source's coordinates agrees in a second, independent hash too (128 bits in all);
   what a document has of a path in consecutive places is one span. Spans go to their documents.

A hash of 64 bits only proposes; md5 of all words (stretches) or 128 bits (edges) decide.

Edge cases: a null or empty text has no words; a text of fewer words than a window has no edges; a null id counts as larger
than any other and never as smaller; rows with one id are one document for the comparison, so they remove nothing from each other,
and each row gets its own result; an empty table gives an empty result; extra columns, also ones with the names used here, are ignored.
Texts can have any length: no row ever holds more than one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, give_back, mix, stored

#: Blank, tab to carriage return: all else belongs to words.
BLANKS = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])
_RANDOM = np.random.default_rng(53)
_BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256).astype(np.uint64)
_PLACE_CODES = _RANDOM.integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_CHECK_CODES = _RANDOM.integers(1, 1 << 63, 256).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rows that a task of step 1 holds before it looks for repeats among them.
HELD_ROWS = 2_000_000


class Words:
    """The words of a batch of texts: where each begins and ends in ``data``, its document's number in the batch, its hash."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = int(offsets[0]) if len(offsets) else 0
        self.data = memoryview(texts.buffers()[2] or b"")[first : int(offsets[-1]) if len(offsets) else 0]
        offsets = offsets - first
        b = np.frombuffer(self.data, np.uint8)
        inside = ~BLANKS[b]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = offsets[1:-1][(offsets[1:-1] < len(b)) & (offsets[1:-1] > 0)]
        opens[edges] = inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | opens[1:]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets)  # the number of each document's first word
        self._bytes = b

    def hashes(self, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
        """One for each word; sums of byte codes times place codes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        b, sizes = self._bytes, self.ends - self.starts
        place = np.arange(len(b)) - np.repeat(np.concatenate([[0], self.starts]), np.diff(np.concatenate([[0], self.starts, [len(b)]])))
        codes = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[b] * _PLACE_CODES[place & 255], dtype=np.uint64)])
        return mix(codes[self.ends] - codes[self.starts] + sizes.astype(np.uint64))

    def text(self, first: int, past: int) -> bytes:
        """The words from ``first`` to before ``past``, joined by one blank."""
        raw, at = self.data, self.starts[first]
        part = bytes(raw[at : self.ends[past - 1]])
        if self.ends[past - 1] - at == int((self.ends[first:past] - self.starts[first:past]).sum()) + past - first - 1 and not any(c in part for c in b"\t\n\v\f\r"):
            return part
        return b" ".join(part.split())


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, by where it starts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _STEP + h[i : i + n]
    return mix(out)


def least(g: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of ``size`` values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        g = np.minimum(g[: len(g) - step], g[step:])
        have += step
    return g


def runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of edges with the same rarest gram: (gram, document in the batch, first edge in the document, edges)."""
    none = np.zeros(0, np.int64)
    if len(words.starts) < window:
        return none.view(np.uint64), none, none, none
    m = least(grams(words.hashes(), gram), window - gram + 1)
    doc = words.doc[: len(m)]
    whole = doc == words.doc[window - 1 :]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]]) & whole
    at = np.flatnonzero(new)
    if not len(at):
        return none.view(np.uint64), none, none, none
    n = np.add.reduceat(whole.astype(np.int64), at)
    return m[at], doc[at], at - words.first[doc[at]], n


#: A row's place: eight bits of the text's hash, first edge, number of edges.
_BITS = 27


def salt(text: str = "text") -> Column:
    """Tells apart rows of one id, so that an id with very many rows isn't one group."""
    return F.pmod(F.xxhash64(text), F.lit(256)).cast("long")


def candidates(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, salt, places): where edges stand whose rarest gram occurs elsewhere too."""
    kind = docs.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, rows, base = [], [], 0, 0

        def told() -> Iterator[pa.RecordBatch]:
            m, d, p = (np.concatenate(x) for x in zip(*held, strict=True))
            names = pa.chunked_array(ids).combine_chunks()
            order = np.lexsort((d, m))
            m, d, p = m[order], d[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(m)]])))
            last = np.concatenate([first[1:], [len(m)]]) - 1
            several = (d[first] != d[last])[group]
            known = np.where(several, 1, 0).astype(np.int8)
            one = first[d[first] != d[last]]  # speaks for the task's rows of this gram
            m, d, p, known = np.concatenate([m, m[one]]), np.concatenate([d, d[one]]), np.concatenate([p, p[one]]), np.concatenate([known, np.full(len(one), 2, np.int8)])
            for at in range(0, len(m), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(m[s].view(np.int64)), names.take(pa.array(d[s])), pa.array(p[s]), pa.array(known[s])], names=["gram", "doc", "place", "known"])

        for b in batches:
            m, d, at, n = runs(Words(b.column(2)), window, gram)
            ids.append(b.column(0))
            if len(m):
                salts = b.column(1).to_numpy()[d]
                held.append((m, d + base, (salts << (2 * _BITS)) | (at << _BITS) | n))
                rows += len(m)
            base += b.num_rows
            if rows >= HELD_ROWS:
                yield from told()
                held, ids, rows, base = [], [], 0, 0
        if held:
            yield from told()
        give_back()

    bounded_batches(docs.sparkSession)
    found = docs.select("doc", "salt", F.col("text").cast("binary")).mapInArrow(find, f"gram LONG, doc {kind}, place LONG, known BYTE")
    # rows known to repeat only pass through, spread by their place
    key = F.when(F.col("known") == 1, F.xxhash64("gram", "doc", "place")).otherwise(F.col("gram"))
    own = Window.partitionBy("key")
    shared = (F.min("doc").over(own) != F.max("doc").over(own)) | ((F.count(F.lit(1)).over(own) > F.count("doc").over(own)) & (F.count(F.lit(1)).over(own) > 1)) | (F.max("known").over(own) == 2)
    # grams are spread by their hash; a row for each task at most stands for a frequent one
    kept = found.withColumn("key", key).withColumn("shared", F.coalesce(shared, F.lit(False))).where("known = 1 OR (known = 0 AND shared)")
    place = F.col("place")
    return kept.groupBy("doc", F.shiftright(place, 2 * _BITS).alias("salt")).agg(F.collect_set(place.bitwiseAND((1 << (2 * _BITS)) - 1)).alias("places"))


def stretches(docs: DataFrame, places: DataFrame, window: int, cut_one_in: int) -> DataFrame:
    """(doc, body, start, edges, digest, words): candidate edges in stretches that every document cuts alike."""
    kind = docs.schema["doc"].dataType.simpleString()
    p = places.select(F.col("doc").alias("_doc"), F.col("salt").alias("_salt"), "places")
    rows = docs.join(p, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("salt") == F.col("_salt")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column(2))
            edge = grams(words.hashes(), window)
            out: list[tuple] = []
            for i in range(b.num_rows):
                low, n = int(words.first[i]), int(words.first[i + 1] - words.first[i]) - window + 1
                if n <= 0:
                    continue
                code = b.column(3)[i].values.to_numpy(zero_copy_only=False)
                at, size = np.minimum(code >> _BITS, n), code & ((1 << _BITS) - 1)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, np.minimum(at + size, n), -1)
                inside = np.concatenate([[False], np.cumsum(step[:n]) > 0, [False]])
                cuts = np.zeros(n + 1, bool)
                cuts[:n] = edge[low : low + n] % np.uint64(cut_one_in) == 0
                begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cuts))
                past = np.flatnonzero(inside[1:-1] & (~inside[2:] | cuts[1:])) + 1
                for x, y in zip(begin.tolist(), past.tolist(), strict=True):
                    text = words.text(low + x, low + y + window - 1)
                    out.append((i, x, y - x, hashlib.md5(text).digest(), text))
                if len(out) > 5000:
                    yield batch(b, out)
                    out = []
            if out:
                yield batch(b, out)
        give_back()

    def batch(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*out, strict=True))
        i = pa.array(c[0])
        return pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], names=["doc", "body", "start", "edges", "digest", "words"])

    bounded_batches(docs.sparkSession)
    return rows.select("doc", F.xxhash64("text").alias("body"), F.col("text").cast("binary"), "places").mapInArrow(cut, f"doc {kind}, body LONG, start LONG, edges LONG, digest BINARY, words BINARY")


def smaller(first: str, doc: str) -> Column:
    """Whether id ``first`` is smaller; null is the largest."""
    return F.col(first).isNotNull() & (F.col(doc).isNull() | (F.col(first) < F.col(doc)))


def edges(open_stretches: DataFrame, window: int) -> DataFrame:
    """(doc, body, at, code, check, head, tail): every edge of the stretches, with two independent hashes of its words, and its nodes."""
    kind = open_stretches.schema["doc"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(b.column(3))
            h = w.hashes()
            code, check, node = grams(h, window), grams(w.hashes(_CHECK_CODES), window), grams(h, window - 1)
            keep = np.flatnonzero(w.doc[: len(code)] == w.doc[window - 1 :]) if len(code) else np.zeros(0, np.int64)
            for k in range(0, len(keep), 100_000):
                at = keep[k : k + 100_000]
                of = w.doc[at]
                i = pa.array(of)
                place = b.column(2).to_numpy()[of] + at - w.first[of]
                yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), *(pa.array(x.view(np.int64)) for x in (place, code[at], check[at], node[at], node[at + 1]))], names=["doc", "body", "at", "code", "check", "head", "tail"])
        give_back()

    bounded_batches(open_stretches.sparkSession)
    return open_stretches.select("doc", "body", "start", "words").mapInArrow(split, f"doc {kind}, body LONG, at LONG, code LONG, check LONG, head LONG, tail LONG")


def compacted(shared: DataFrame) -> DataFrame:
    """(code, check, source, path_at, offset): the distinct edges in nonbranching paths of consecutive places of their first document.

    ``source`` is the first place (id, body, at) of an edge, ``path_at`` where in that text its path begins, ``offset`` the edge's number in it.
    """
    distinct = stored(shared.groupBy("code", "check").agg(F.min(F.struct(F.col("doc").isNull().alias("absent"), "doc", "body", "at")).alias("source"), F.first("head").alias("head"), F.first("tail").alias("tail")), "graph-edges")
    ends = distinct.select(F.col("tail").alias("node"), F.lit(1).alias("enter"), F.lit(0).alias("leave"), "source").unionByName(distinct.select(F.col("head").alias("node"), F.lit(0).alias("enter"), F.lit(1).alias("leave"), F.lit(None).cast(distinct.schema["source"].dataType).alias("source")))
    nodes = ends.groupBy("node").agg(F.sum("enter").alias("enter"), F.sum("leave").alias("leave"), F.min("source").alias("before"))
    joined = distinct.join(nodes, distinct["head"] == nodes["node"], "left")
    same = F.col("before.doc").eqNullSafe(F.col("source.doc")) & (F.col("before.body") == F.col("source.body")) & (F.col("before.at") + 1 == F.col("source.at"))
    goes_on = (F.col("enter") == 1) & (F.col("leave") == 1) & same
    along = Window.partitionBy("source.doc", "source.body").orderBy("source.at")
    opens = F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("source.at"))
    marked = joined.withColumn("path_at", F.last(opens, ignorenulls=True).over(along))
    return marked.select("code", "check", "source", F.col("path_at"), (F.col("source.at") - F.col("path_at")).alias("offset"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, cut_one_in: int = 8) -> DataFrame:
    """(doc, body, spans): for each row that loses words, its id, the xxhash64 of its text, and structs (first, past) of word numbers."""
    gram = max(1, min(gram, window - 1))
    rows = docs.select(F.col(id_col).alias("doc"), salt(text_col).alias("salt"), F.col(text_col).alias("text")).where(F.octet_length("text") >= 2 * window - 1)
    places = stored(candidates(rows, window, gram), "candidate-edges")
    found = stored(stretches(rows, places, window, cut_one_in), "stretches")
    # stored, so that the join has a shuffle of its own for each side and Spark can split a frequent stretch
    firsts = stored(found.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-stretches")
    judged = found.join(firsts, F.col("digest") == F.col("_digest"), "left").withColumn("late", smaller("first_doc", "doc"))
    judged = stored(judged.select("doc", "body", "start", "edges", "late", F.when(~F.col("late"), F.col("words")).alias("words")), "judged")
    span = F.struct(F.col("start").alias("first"), (F.col("start") + F.col("edges") + window - 1).alias("past"))
    whole = judged.where("late").select("doc", "body", span.alias("span"))

    every = edges(judged.where("NOT late"), window)
    codes = every.groupBy(F.col("code").alias("_code")).agg(F.min("doc").alias("_low"), F.max("doc").alias("_high"), F.count(F.lit(1)).alias("_n"), F.count("doc").alias("_named"))
    codes = stored(codes.where("_low < _high OR (_named > 0 AND _n > _named)").select("_code"), "shared-codes")
    shared = stored(every.join(codes, F.col("code") == F.col("_code"), "left_semi"), "shared-edges")
    paths = compacted(shared).select(F.col("code").alias("_code"), F.col("check").alias("_check"), "source", "path_at", "offset")
    # both hashes agree at the source's place: what a document has of a path, in consecutive places, is a span
    on = shared.join(paths, (F.col("code") == F.col("_code")) & (F.col("check") == F.col("_check"))).select("doc", "body", "at", "source", "path_at", "offset")
    on = on.where(F.col("source.doc").isNotNull() & (F.col("doc").isNull() | (F.col("source.doc") < F.col("doc"))))
    diagonal = Window.partitionBy("doc", "body", "source.doc", "source.body", "path_at", F.col("at") - F.col("offset")).orderBy("at")
    islands = on.withColumn("island", F.col("at") - F.row_number().over(diagonal)).groupBy("doc", "body", F.col("source.doc").alias("source_doc"), F.col("source.body").alias("source_body"), "path_at", "island")
    pieces = islands.agg(F.min("at").alias("first"), (F.max("at") + window).alias("past")).select("doc", "body", F.struct("first", "past").alias("span"))
    pieces = stored(pieces, "spans")
    return whole.unionByName(pieces).groupBy("doc", "body").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, cut_one_in: int = 8) -> DataFrame:
    """(id, n_words, n_removed, spans, kept): every row with the words that stay, joined by one blank; a repeated row comes as often as it occurs."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, gram=gram, cut_one_in=cut_one_in)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_body"), F.col(text_col).alias("text"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("doc")) & (F.col("_body") == F.col("body")), "left").select("id", F.col("text").cast("binary"), "spans")
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, said in zip(b.column(1), b.column(2), strict=True):
                w = (text.as_py() or b"").split()
                merged: list[list[int]] = []
                for s in said.as_py() or ():
                    if merged and s["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["past"])
                    else:
                        merged.append([s["first"], s["past"]])
                kept, at = [], 0
                for x, y in merged:
                    kept += w[at:x]
                    at = y
                kept += w[at:]
                out.append((len(w), len(w) - len(kept), [{"first": x, "past": y} for x, y in merged], b" ".join(kept).decode()))
            c = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], spans_type), pa.array(c[3], pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])
        give_back()

    bounded_batches(docs.sparkSession)
    return joined.mapInArrow(keep, f"id {kind}, n_words LONG, n_removed LONG, spans ARRAY<STRUCT<first: LONG, past: LONG>>, kept STRING")


ORACLE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all("text", '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)
), firsts AS MATERIALIZED (
  SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (s) WHERE first_doc < doc_id OR (doc_id IS NULL AND first_doc IS NOT NULL)
), word AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)
"""
