"""Registered queries against their SQL on the smallest tables, and the registry itself."""

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from oracle import connect, differences
from quillgraph.plans import catalogue, more  # noqa: F401

NAMES = [
    "a_edge_strength_top", "a_claim_dedup", "a_edges", "a_entity_statistics", "a_predicate_rollup", "a_coverage", "a_basis_hash", "a_picked_claims", "b_ego", "b_related", "b_shortest_paths", "b_components",
    "c_r1_reversal", "c_r2_after_death", "c_r4_functional_conflict", "c_m1_inverted", "c_s3_parallel_definitions", "d_review_queue", "d_decisions_folded", "d_files_registered", "e_keywords", "e_located", "e_page_text",
    "f_tiles", "f_drift", "f_centroids", "f_outliers", "f_nearest", "g_flows", "g_time_range", "g_task_counts", "g_top_and_other", "h_tumbling", "h_sliding", "h_sessions", "h_over_limit",
    "i_roman", "i_names", "i_sizes", "i_jitter", "i_random", "i_times", "i_chapters", "i_headings", "i_clean_claims", "j_resolved", "j_components", "k_silhouette", "k_density", "k_board_sizes", "l_search", "l_missing_notes",
    "l_mentioned", "m_chapter_cast", "m_lanes", "m_frontier", "m_page_numbers", "m_margins", "m_paragraphs_of_ocr",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    assert differences(got, duck.sql(catalogue.ORACLE[name]).df()) == ""


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 30


def test_communities_are_a_partition_better_than_chance(spark):
    m, g, labels = catalogue._community(catalogue.Tables(spark, SMALL))
    assert labels.count() == labels.select("node").distinct().count() == g.selectExpr("explode(array(a, b)) AS n").distinct().count()
    from quillgraph.operators import graph

    assert graph.modularity(g, labels).first()[0] >= -1e-9


def test_segments_hold_the_whole_text(spark):
    got = catalogue.QUERIES["e_segments"](spark, SMALL).orderBy("id", "idx").toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for doc, parts in got.groupby("id"):
        assert "".join("".join(parts["text"]).split()) == "".join(docs[doc].split())
