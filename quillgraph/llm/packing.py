"""Packing: first-fit decreasing over a tournament tree of bin capacities, run in randomised groups of documents.

``token_pieces`` tokenises whole texts and cuts each document into pieces of at most ``max_tokens`` ids;
``assign_sequences`` deals the pieces of each group into sequences; ``sequences`` builds the packed id lists.

Only piece lengths are shuffled for the packing. A group is a hash class of (id, number of the row), so each has about
``group_docs`` documents however the table is ordered and however often an id comes, and every group is packed by itself.

Edge cases: a null or empty text is the end-of-document id alone; a null id packs like any other; repeated rows are packed
as often as they occur (a text of any length is cut into pieces), and pieces of equal length go by id, start and content; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, give_back

PIECE_SCHEMA = "doc_id {id}, pack_group LONG, start LONG, length LONG, ids BINARY, doc_tokens LONG"
PACKED = "doc_id {id}, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, offset LONG, sequence_tokens LONG, padded_tokens LONG"
#: A blank before white space or the end.
ODD = r" ([\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]|$)"
#: Entries of a cache; when it is full half of it goes, so memory is bounded. ``KEPT`` of them outlive a task.
CACHE, KEPT = 500_000, 150_000
#: Bytes of text that are split and looked up at a time (a longer text goes by itself).
BATCH_BYTES = 4 << 20


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, as little-endian 32-bit bytes.

    With byte-level pre-tokenisation a token never reaches across a blank that a non-blank follows, so a text is the words
    between its blanks. Words are looked up in a cache; the tokenizer encodes, in one text, those it hasn't seen.
    """

    def __init__(self, tokenizer_path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            said = json.load(f)
        # a text with the string of an added token goes to the tokenizer as it is
        self.added = [t["content"] for t in said.get("added_tokens") or () if t.get("content")]
        kind = said.get("pre_tokenizer") or {}
        self.plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not said.get("normalizer")
        self.words: dict[str, bytes] = {"": b""}  # without the blank before them
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # the byte-level alphabet has one character a byte
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text. Texts with runs of white space at a blank, or with an added token, go to the tokenizer as they are."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.plain:
            return self.direct(texts.to_pylist())
        odd = pc.match_substring_regex(texts, ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        even = iter(self.by_words(texts.filter(pc.invert(odd))))
        whole = iter(self.direct(texts.filter(odd).to_pylist()))
        return [next(whole if x else even) for x in odd.to_pylist()]

    def by_words(self, texts: pa.Array) -> list[bytes]:
        """Arrow splits the texts and numbers their distinct words; each of these is looked up once."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        known, codes, ends = coded.dictionary.to_pylist(), coded.indices, lists.offsets.to_numpy()
        ends = ends - ends[0]
        if len(self.words) > CACHE:
            self.forget(CACHE // 2)
        new = [w for w in known if w not in self.words]
        self.learn(new)
        heads = codes.take(pa.array(ends[:-1])).to_pylist()
        opening = dict(zip(set(heads), self.direct([known[k] for k in set(heads)]), strict=True))
        # the bytes of all words in a row, and where each text's second word begins and its last ends
        ids = pa.array(map(self.words.__getitem__, known), pa.large_binary(), size=len(known)).take(codes)
        data, at = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        out = [opening[k] + data[x:y] for k, x, y in zip(heads, at[ends[:-1] + 1].tolist(), at[ends[1:]].tolist(), strict=True)]
        for w in new:  # words across lines hardly come again
            if "\n" in w:
                del self.words[w]
        return out

    def forget(self, kept: int) -> None:
        """Keep so many entries: those that came first, which are the most frequent ones."""
        self.words = dict(islice(self.words.items(), kept))

    def learn(self, new: list[str]) -> None:
        """Add the ids of words, encoded in one text and cut where the bytes of each word end."""
        if not new:
            return
        text = " " + " ".join(new)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        past = np.cumsum(self.sizes[ids])
        sizes = pc.binary_length(pa.array(new, pa.large_string()).cast(pa.large_binary())).to_numpy().astype(np.int64)
        wanted = np.cumsum(sizes + 1)
        last = np.searchsorted(past, wanted)
        if last[-1] == len(ids) - 1 and (past[last] == wanted).all():
            raw, ends = ids.tobytes(), (4 * (last + 1)).tolist()
            self.words.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        else:
            self.words.update(zip(new, self.direct([" " + w for w in new]), strict=True))


@lru_cache(1)
def encoder(tokenizer_path: str) -> Encoder:
    """One encoder a worker process, so tasks after the first find its caches filled."""
    return Encoder(tokenizer_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, eos_id: int = 0, group_docs: int = 2048) -> DataFrame:
    """One row a piece: its ids (little-endian 32 bit), where it starts in its document, and its document's packing group."""
    groups = max(1, -(-docs.count() // group_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    group = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id(), F.lit(29)), F.lit(groups))
    rows = docs.select(F.col(id_col).alias("doc_id"), group.alias("pack_group"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end, step = int(eos_id).to_bytes(4, "little"), 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path)
        encode = known.encode

        def cut(b: pa.RecordBatch) -> Iterator[tuple]:
            turn = np.cumsum(pc.binary_length(b.column(2)).to_numpy().astype(np.int64)) // BATCH_BYTES
            edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for at, past in zip(edges, edges[1:], strict=False):
                some = b.slice(at, past - at)
                yield from pieces_of(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2))

        def pieces_of(docs: list, groups: list, texts: pa.Array) -> Iterator[tuple]:
            for doc, g, ids in zip(docs, groups, encode(texts), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    yield doc, g, at // 4, min(step, len(ids) - at) // 4, ids[at : at + step], len(ids) // 4

        for b in batches:
            pieces = cut(b)
            while some := list(islice(pieces, 2000)):
                c = list(zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), *(pa.array(x, pa.int64()) for x in c[1:4]), pa.array(c[4], pa.binary()), pa.array(c[5], pa.int64())], names=["doc_id", "pack_group", "start", "length", "ids", "doc_tokens"])
        known.forget(KEPT)
        give_back()

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(run, PIECE_SCHEMA.format(id=kind))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, given in falling order.

    A tournament tree holds the room of every bin, and in each inner node the larger of its two children, so the first
    bin that has room is found, and its room brought up to date, in log(bins) steps.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        where[k], offset[k] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return where, offset


def assign_sequences(pieces: DataFrame, *, max_tokens: int = 1024) -> DataFrame:
    """The sequence and the gapless offset of every piece (columns of ``PACKED``; ``pieces`` needs ids_crc32, not ids).

    A sequence is padded to ``max_tokens``, except where its length is a power of two.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = [x.split(" ")[0] for x in PACKED.split(", ")]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = first_fit_decreasing(g["length"].to_numpy(), max_tokens)
        total = np.bincount(where, g["length"].to_numpy()).astype(np.int64)[where]
        padded = np.where(total & (total - 1) == 0, total, max_tokens)
        return g.assign(sequence_id=g["pack_group"] * (1 << 32) + where, offset=offset, sequence_tokens=total, padded_tokens=padded)[names]

    return pieces.select("doc_id", "pack_group", "start", "length", "ids_crc32", "doc_tokens").groupBy("pack_group").applyInPandas(pack, PACKED.format(id=kind))


def with_digest(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids themselves."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed id lists, unpadded; repeated rows that are alike in id, start and ids count as one piece each.

    Joins the ids back on (doc_id, start, crc) after numbering equal rows, so each piece keeps its own place.
    """
    from pyspark.sql import Window

    def numbered(df: DataFrame, order: list[str]) -> DataFrame:
        keys = ["doc_id", "start", "ids_crc32", "length"]
        return df.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    left = numbered(pieces.withColumn("ids_crc32", F.crc32("ids")), ["pack_group"]).select("doc_id", "start", "ids_crc32", "length", "copy", "ids")
    right = numbered(packed, ["sequence_id", "offset"]).select("doc_id", "start", "ids_crc32", "length", "copy", "sequence_id", "offset")
    same = [left[c].eqNullSafe(right[c]) for c in ("doc_id", "start", "ids_crc32", "length", "copy")]
    joined = left.join(right, same).select("sequence_id", "offset", "ids")
    return joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
