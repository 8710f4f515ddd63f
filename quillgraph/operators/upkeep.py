"""Upkeep of relations when claims are rejected or restored: counts and sums are moved by the change alone.

Only a relation whose largest or smallest value may have left is read again from its claims; all others are brought up to date
from the change, which is usually much smaller than the claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.edges import EDGE

STATE = [*EDGE, "support_count", "confidence_sum", "confidence", "first_chapter", "last_chapter"]


def relation_state(claims: DataFrame) -> DataFrame:
    """(STATE): relations with what can be kept up; confidences are summed in whole millionths, so sums can be taken back."""
    return claims.groupBy(*EDGE).agg(
        F.count(F.lit(1)).alias("support_count"), F.sum(F.round(F.coalesce("confidence", F.lit(0.0)) * 1_000_000).cast("long")).alias("confidence_sum"), F.max("confidence").alias("confidence"),
        F.min("ch").alias("first_chapter"), F.max("ch").alias("last_chapter"),
    )


def after_change(state: DataFrame, removed: DataFrame, added: DataFrame, claims: DataFrame) -> DataFrame:
    """The state after ``removed`` claims left and ``added`` ones came; ``claims`` are all that count afterwards.

    Each removed claim was in the state, each added one wasn't. A relation without claims goes. Null keys are keys like any other.
    """
    def told(df: DataFrame, mark: str) -> DataFrame:
        s = relation_state(df)
        return s.select(*EDGE, *(F.col(c).alias(f"{mark}_{c}") for c in STATE[len(EDGE) :]))

    def joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        named = b.select(*(F.col(c).alias(f"_{c}") for c in EDGE), *(c for c in b.columns if c not in EDGE))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in EDGE]
        whole = a.join(named, on, how)
        if how != "full":
            return whole.drop(*(f"_{c}" for c in EDGE))
        return whole.select(*(F.coalesce(c, f"_{c}").alias(c) for c in EDGE), *(c for c in whole.columns if c not in EDGE and c not in {f"_{c}" for c in EDGE}))

    all_of = joined(joined(state, told(removed, "out"), "left"), told(added, "in"), "full")
    n = F.coalesce("support_count", F.lit(0)) - F.coalesce("out_support_count", F.lit(0)) + F.coalesce("in_support_count", F.lit(0))
    total = F.coalesce("confidence_sum", F.lit(0)) - F.coalesce("out_confidence_sum", F.lit(0)) + F.coalesce("in_confidence_sum", F.lit(0))
    left = (F.col("out_confidence") >= F.col("confidence")) | (F.col("out_first_chapter") <= F.col("first_chapter")) | (F.col("out_last_chapter") >= F.col("last_chapter"))
    moved = all_of.withColumns({"_n": n, "_sum": total, "_again": F.coalesce(left, F.lit(False))}).where("_n > 0")
    kept = moved.where("NOT _again").select(
        *EDGE, F.col("_n").alias("support_count"), F.col("_sum").alias("confidence_sum"), F.greatest("confidence", "in_confidence").alias("confidence"), F.least("first_chapter", "in_first_chapter").alias("first_chapter"), F.greatest("last_chapter", "in_last_chapter").alias("last_chapter")
    )
    again = moved.where("_again").select(*EDGE).distinct()
    return kept.unionByName(relation_state(joined(claims, again, "left_semi")))
