"""Chat formatting: cumulative snapshots are collapsed before conversations are rendered. DataFrame functions only.

Logs often hold a conversation again after each turn. Each conversation's rolling turn-prefix hashes (running over its turns:
128 bits of the hashes of each turn at its place) show which whole conversations are a prefix of a longer one; an anti-join
keeps the maximal ones.

The hashes run in a window over the turns, so their cost is linear in the turns, and a conversation is a row only once it is
rendered; what was computed is stored once and read by both sides. Equal conversations are first reduced to one row, and prefix
hashes to distinct ones (both by aggregates that combine on the map side), so a first turn or conversation that a third
of the log shares is one row in either side of the anti-join.

Edge cases: a null role is ``unknown`` and a null text is empty, and they compare so; identical rows of a turn count once,
different ones follow each other by role, then text; a turn without conversation id is a conversation of its own; turns
without number come first; an empty table gives no rows; extra columns are ignored. Template marks inside a text are broken
up by a blank, so no text can forge a turn. Very long texts and conversations are sorted with spilling; only a rendered
conversation must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, conv_id, turns): one row a conversation, its turns as an ordered array of (place, role, text, h1, h2); the key is never null.

    h1 and h2 are the rolling hashes of the turns up to that place.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("unknown")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("alone "), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256)))
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = F.lag("turn").over(order).eqNullSafe(F.col("turn")) & (F.lag("role").over(order) == F.col("role")) & (F.lag("text").over(order) == F.col("text"))
    once = rows.withColumn("key", key).withColumn("again", F.coalesce(again, F.lit(False))).where(~F.col("again"))
    placed = once.withColumn("place", F.row_number().over(order))
    hashed = placed.withColumns({f"h{i}": F.bit_xor(F.xxhash64("place", "role", "text", F.lit(i))).over(running) for i in (1, 2)})
    return hashed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("place", "role", "text", "h1", "h2"))).alias("turns"))


def render(turns: Column) -> Column:
    """The conversation in the chat template, template marks in its roles and texts broken up."""

    def safe(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))

    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))))


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """conv_id (the smallest of equal ones), n_turns, n_copies (equal conversations), rendered: the maximal conversations."""
    every = stored(conversations(turns, **columns), "chat")
    # turns stay where they are: only hashes and keys meet those of equal conversations
    last, size = F.element_at("turns", -1), F.size("turns").cast("long")
    first = F.struct(F.col("conv_id").isNull().alias("last"), "conv_id", "key")
    whole = every.groupBy(size.alias("n_turns"), last["h1"].alias("h1"), last["h2"].alias("h2")).agg(F.min(first).alias("first"), F.count("*").alias("n_copies"))
    parts = every.select(F.explode(F.arrays_zip("turns.place", "turns.h1", "turns.h2")).alias("p"), size.alias("n")).where("p.place < n")
    prefixes = parts.select(F.col("p.place").cast("long").alias("n_turns"), F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2")).distinct()
    kept = whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select(F.col("first.key").alias("key"), "n_copies")
    found = every.join(kept, "key")
    return found.select("conv_id", size.alias("n_turns"), "n_copies", render(F.col("turns")).alias("rendered"))


#: The same in DuckDB's SQL, without hashes: prefixes are compared as text.
ORACLE_SQL = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce("text", '') AS txt FROM conversations
), keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'alone ' || coalesce(CAST(turn AS VARCHAR), '') || ' ' || length(role) || ' ' || role || txt) AS key FROM rows
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, txt) AS k, count(*) OVER (PARTITION BY key) AS n FROM keyed
), prefixes AS (
  SELECT conv_id, k, n,
         string_agg(length(role) || ':' || role || ':' || length(txt) || ':' || txt, '|') OVER (PARTITION BY key ORDER BY k) AS prefix,
         string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
           || replace(replace(txt, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '')
           OVER (PARTITION BY key ORDER BY k) AS rendered
  FROM numbered
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies, min(rendered) AS rendered
  FROM prefixes WHERE k = n GROUP BY prefix
)
SELECT conv_id, n_turns, n_copies, rendered FROM whole
WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE k < n)
"""
