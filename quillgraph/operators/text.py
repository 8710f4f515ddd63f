"""Passages and words: segments of units, keywords, names in texts, quotations located in a collection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-cased words of ASCII letters with at least ``least`` of them."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0), lambda w: F.length(w) >= least)


def keywords(docs: DataFrame, group: str, *, id_col: str = "doc_id", text_col: str = "text", min_df: int = 2, max_share: float = 0.35, top: int = 10) -> DataFrame:
    """(group, word, weight, rank): per group, the words with the largest share among its kept words times inverse document frequency.

    A word is kept if at least ``min_df`` documents and at most ``max_share`` of all have it. Counts are pre-aggregated on the map side.
    """
    n = docs.count()
    words = docs.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.explode(tokens(F.col(text_col))).alias("word"))
    per_doc = words.groupBy("id", "g", "word").agg(F.count("*").alias("c"))
    df = per_doc.groupBy("word").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n))
    tf = per_doc.groupBy("g", "word").agg(F.sum("c").alias("c")).join(df, "word")
    total = tf.groupBy("g").agg(F.sum("c").alias("total"))
    weight = F.round(F.col("c") / F.col("total") * (F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1), 5)
    w = Window.partitionBy("g").orderBy(F.desc("weight"), "word")
    ranked = tf.join(total, "g").withColumn("weight", weight).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select(F.col("g").alias(group), "word", "weight", "rank")


def cut_segments(paragraphs: list[str], target: int) -> list[tuple[str, int]]:
    """Passages of about ``target`` characters with the paragraph each starts in.

    Paragraphs over 1.6 times the target are cut at sentence ends; a passage closes at 0.8 times the target; a rest under 0.4
    times joins the last passage.
    """
    parts: list[tuple[str, int]] = []
    for at, paragraph in enumerate(paragraphs):
        if len(paragraph) <= 1.6 * target:
            parts.append((paragraph, at))
            continue
        held = ""
        for sentence in SENTENCE.split(paragraph):
            if held and len(held) + len(sentence) > target:
                parts.append((held.strip(), at))
                held = ""
            held = f"{held} {sentence}" if held else sentence
        if held:
            parts.append((held, at))
    out: list[tuple[str, int]] = []
    open_parts: list[tuple[str, int]] = []
    for part in parts:
        open_parts.append(part)
        if sum(len(t) for t, _ in open_parts) >= 0.8 * target:
            out.append(("\n".join(t for t, _ in open_parts), open_parts[0][1]))
            open_parts = []
    if open_parts:
        text, size = "\n".join(t for t, _ in open_parts), sum(len(t) for t, _ in open_parts)
        if out and size < 0.4 * target:
            out[-1] = (out[-1][0] + "\n" + text, out[-1][1])
        else:
            out.append((text, open_parts[0][1]))
    return out


def segments(units: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: int = 500) -> DataFrame:
    """(id, idx, para, text) of all passages; paragraphs are the lines of the text that aren't blank."""
    kind = units.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = cut_segments([p.strip() for p in (text.as_py() or "").split("\n") if p.strip()], target)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), b.schema.field(0).type), pa.array(range(len(found)), pa.int32()), pa.array([p for _, p in found], pa.int32()), pa.array([t for t, _ in found])], names=["id", "idx", "para", "text"])

    return units.select(id_col, text_col).mapInArrow(run, f"id {kind}, idx INT, para INT, text STRING")


def windows(units: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 6000) -> DataFrame:
    """(id, window, first, past): whole paragraphs packed in order into windows of at most ``limit`` characters (a longer paragraph is one alone).

    An ordered fold over the paragraph lengths within the row; no Python.
    """
    sizes = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), F.length)
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["size"] > 0) & (acc["size"] + n > limit)
        return F.struct(F.when(full, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"), F.when(full, n).otherwise(acc["size"] + n).alias("size"), (acc["at"] + 1).alias("at"))

    folded = units.select(F.col(id_col).alias("id"), F.aggregate(sizes, start, step).alias("f"))
    return folded.select("id", F.posexplode("f.starts").alias("window", "first"), F.col("f.starts").alias("s"), F.col("f.at").alias("n")).select("id", "window", "first", F.coalesce(F.get("s", F.col("window") + 1), F.col("n")).alias("past"))


def name_counts(units: DataFrame, names: list[tuple[str, str]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity_id, n): how often each entity's names stand in a text; the longest name at a place wins, names don't overlap.

    Names of ASCII letters or digits match whole words only. ``names`` is (entity_id, name) of a bounded dictionary; names under
    two characters don't count; of equal names the first entity has it.
    """
    kind = units.schema[id_col].dataType.simpleString()
    owner: dict[str, str] = {}
    for entity, name in names:
        if name and len(name) >= 2:
            owner.setdefault(name, entity)
    shared = units.sparkSession.sparkContext.broadcast(owner)

    def pattern(known: list[str]) -> re.Pattern:
        def bounded(n: str) -> str:
            ascii_word = re.compile("[A-Za-z0-9]")
            return ("(?<![A-Za-z0-9])" if ascii_word.match(n[0]) else "") + re.escape(n) + ("(?![A-Za-z0-9])" if ascii_word.match(n[-1]) else "")

        return re.compile("|".join(map(bounded, sorted(known, key=len, reverse=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        who = shared.value
        # names that are one word are looked up; the pattern is for texts in which another name stands
        others, words, whole = [n for n in who if not re.fullmatch("[A-Za-z0-9]+", n)], re.compile("[A-Za-z0-9]+").findall, pattern(list(who)).findall

        def find(text: str) -> Iterator[str]:
            return iter(whole(text)) if any(n in text for n in others) else filter(who.__contains__, words(text))

        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                count = Counter(who[m] for m in find(text.as_py() or ""))
                rows += [(doc, e, n) for e, n in count.items()]
            c = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64())], names=["id", "entity_id", "n"])

    return units.select(id_col, text_col).mapInArrow(run, f"id {kind}, entity_id STRING, n LONG")


def located(units: DataFrame, quotes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quote_id: str = "item_id", quote_text: str = "text", probe: int = 40, block: int = 50_000) -> DataFrame:
    """(quote_id, id): the first unit (smallest id) that contains the middle ``probe`` characters of each quotation, white space aside.

    Quotations are taken in blocks of a bounded size; a block's automaton passes over all units once.
    """
    kind, q_kind = units.schema[id_col].dataType.simpleString(), quotes.schema[quote_id].dataType.simpleString()
    flat = F.regexp_replace(F.coalesce(F.col(quote_text), F.lit("")), r"\s+", "")
    probes = quotes.select(F.col(quote_id).alias("q"), F.substring(flat, F.greatest(F.lit(1), F.floor((F.length(flat) - probe) / 2).cast("int") + 1), F.lit(probe)).alias("p")).where("p <> ''")
    blocks = max(1, -(-probes.count() // block))
    out = None
    for k in range(blocks):
        part = probes.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).toArrow().to_pydict()
        shared = units.sparkSession.sparkContext.broadcast(list(zip(part["q"], part["p"], strict=True)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine, owners = ahocorasick.Automaton(), {}
            for q, p in shared.value:
                owners.setdefault(p, []).append(q)
            for p, qs in owners.items():
                machine.add_word(p, qs)
            machine.make_automaton()
            for b in batches:
                rows = [(q, doc) for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for q in {q for _, qs in (machine.iter("".join((text.as_py() or "").split())) if owners else ()) for q in qs}]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64() if q_kind == "bigint" else pa.string()), pa.array([d for _, d in rows], b.schema.field(0).type)], names=["q", "id"])

        got = units.select(id_col, text_col).mapInArrow(run, f"q {q_kind}, id {kind}").groupBy("q").agg(F.min("id").alias("id"))
        out = got if out is None else out.unionByName(got)
    return out.select(F.col("q").alias(quote_id), "id")
