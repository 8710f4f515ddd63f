"""The material of answers: what a table of questions mentions, the facts of pairs and of single entities, numbered for citing."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.contain import texts_within
from quillgraph.operators.edges import EDGE
from quillgraph.plans.storage import stored


def _as_it_is(c: Column) -> Column:
    return c


def _any(_: Column) -> Column:
    return F.lit(True)


class Spelling(NamedTuple):
    """How entities, predicates and claims that travel as codes are written. Ties are broken by what is written; it is made after the shuffles."""

    entity: Callable[[Column], Column] = _as_it_is
    predicate: Callable[[Column], Column] = _as_it_is
    claim: Callable[[Column], Column] = _as_it_is


def mentions(questions: DataFrame, names: DataFrame, most: int = 4, entity: Callable[[Column], Column] = _as_it_is) -> DataFrame:
    """(question_id, entity_id, i): the first ``most`` entities that stand in each question (id, text), counted from 1 by their first place.

    Names are (id, text), any number to an entity; they are found by way of grams that they share with questions. ``entity`` spells ids that are codes.
    """
    found = texts_within(names, questions).withColumn("place", F.expr("instr(hay, needle)"))
    # entities of one name stand at one place, so of them only the first ``most`` can be among the first of a text
    same = names.select(F.col("id").alias("entity_id"), F.col("text").alias("needle")).distinct()
    same = same.withColumn("i", F.row_number().over(Window.partitionBy("needle").orderBy(entity(F.col("entity_id"))))).where(F.col("i") <= most).drop("i")

    def first(placed: DataFrame, key: str) -> DataFrame:
        one = placed.groupBy(key, "entity_id").agg(F.min("place").alias("place"))
        return one.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("place", entity(F.col("entity_id"))))).where(F.col("i") <= most)

    of_text = first(found.join(same, "needle"), "hay").drop("i")
    asked = questions.select(F.col("id").alias("question_id"), F.col("text").alias("hay")).distinct()
    return first(asked.join(of_text, "hay"), "question_id").select("question_id", "entity_id", "i")


def with_firsts(metrics: DataFrame, claims: DataFrame, per_edge: int = 2) -> DataFrame:
    """(src, predicate, dst, weight, firsts): ``metrics`` with the first ``per_edge`` claims of each edge; ``edges.cited_edges`` makes both at once."""
    w = Window.partitionBy(*EDGE).orderBy("ch", "claim_id")
    few = claims.select(*EDGE, "ch", "claim_id").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_edge)
    firsts = few.groupBy(*EDGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "claim_id"))), lambda x: x["claim_id"]).alias("firsts"))
    return metrics.select(*EDGE, "weight").join(firsts, EDGE)


def picks(relations: DataFrame, entities: DataFrame, most: int, spelling: Spelling = Spelling(), may: Callable[[Column], Column] = _any) -> DataFrame:
    """(entity_id, claim_id, r): for each of ``entities`` (entity_id) its claims in the order in which a note cites them.

    The first claim of each edge from the strongest on, then the second of each, up to ``most``. ``relations`` bring (src, predicate,
    dst, weight, firsts); their claims are spread to the ends that ``may`` be among ``entities`` and shuffled once.
    """
    ends = relations.withColumn("entity_id", F.explode(F.array_distinct(F.array("src", "dst")))).where(may(F.col("entity_id"))).select("entity_id", *EDGE, "weight", F.posexplode("firsts").alias("turn", "claim_id"))
    ends = ends.repartition("entity_id").join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    edge = [spelling.entity(F.col("src")), spelling.predicate(F.col("predicate")), spelling.entity(F.col("dst"))]
    order = Window.partitionBy("entity_id").orderBy("turn", F.desc("weight"), *edge)
    return ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("entity_id", "claim_id", "r")


def gather(questions: DataFrame, names: DataFrame, metrics: DataFrame, claims: DataFrame, *, most: int = 40, least_each: int = 6, per_pair: int = 8, enough: int = 24, spelling: Spelling = Spelling(), may: Callable[[Column], Column] = _any) -> DataFrame:
    """(question_id, n, claim_id, about): the facts to answer each question with, numbered from 1.

    First the claims between two mentioned entities, pair by pair until ``enough`` are there; then for each entity in turn its
    picked claims, an equal share of what is left but ``least_each`` at least; none twice, ``most`` in all. ``about`` is the pair
    or the entity. A question that mentions nobody has no rows. Where ``metrics`` bring the ``firsts`` of each edge, ``claims`` are
    read for pairs only; ids may then be codes, which ``spelling`` writes out. ``may`` tells
    from an id whether names can have it, so that the claims of others needn't travel.
    """
    asked = stored(mentions(questions, names, entity=spelling.entity), "mentions")
    other = asked.select("question_id", F.col("entity_id").alias("other"), F.col("i").alias("j"))
    pairs = asked.join(other, "question_id").where("i < j").select("question_id", F.col("entity_id").alias("one"), "other", F.struct("i", "j").alias("at"))
    a, b = F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")
    wanted = pairs.select(a, b).distinct()
    between = claims.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "claim_id").join(wanted, ["a", "b"], "left_semi").distinct()
    between = between.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(spelling.claim(F.col("claim_id"))))).where(F.col("r") <= per_pair)
    listed = pairs.select("question_id", a, b, "at", "one", "other").join(between, ["a", "b"])
    # a pair counts while the pairs before it bring fewer than ``enough``
    sizes = listed.groupBy("question_id", "at").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("question_id").orderBy("at")) - F.col("size")
    open_pairs = sizes.withColumn("before", before).where(F.col("before") < enough).select("question_id", "at")
    facts = listed.join(open_pairs, ["question_id", "at"], "left_semi").select("question_id", "claim_id", F.lit(0).alias("stage"), F.col("at.i").alias("x"), F.col("at.j").alias("y"), "r", "one", "other")
    facts = stored(facts, "pair-facts")
    room = asked.groupBy("question_id").agg(F.count(F.lit(1)).alias("k")).join(facts.groupBy("question_id").agg(F.count_distinct("claim_id").alias("n")), "question_id", "left")
    share = room.select("question_id", F.greatest(F.lit(least_each), F.floor((most - F.coalesce("n", F.lit(0))) / F.col("k"))).alias("each"))
    relations = metrics if "firsts" in metrics.columns else with_firsts(metrics, claims)
    chosen = picks(relations, asked, most, spelling, may)
    nobody = F.lit(None).cast(facts.schema["other"].dataType)
    own = asked.join(share, "question_id").join(chosen, "entity_id").where("r <= each").select("question_id", "claim_id", F.lit(1).alias("stage"), F.col("i").alias("x"), F.lit(0).alias("y"), "r", F.col("entity_id").alias("one"), nobody.alias("other"))
    # dealt by question once, for the rows of a claim and for the count; stage, x, y and r tell a question's rows apart
    once = facts.unionByName(own).repartition("question_id").groupBy("question_id", "claim_id").agg(F.min(F.struct("stage", "x", "y", "r", "one", "other")).alias("o"))
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("o"))).where(F.col("n") <= most)
    about = F.concat_ws(" ", spelling.entity(F.col("o.one")), spelling.entity(F.col("o.other")))
    return once.select("question_id", "n", spelling.claim(F.col("claim_id")).alias("claim_id"), about.alias("about"))
