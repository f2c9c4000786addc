"""Every query of the library against its SQL twin on the smallest tables."""

import pytest

from corpusmill import catalog
from tests.oracle import check

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLES[name])


def test_queries_without_sql_are_tested_elsewhere():
    tested = {"text_sequence_ratio", "ivf_probed"}  # test_whole.py
    tested |= {"rag_evaluation_longest", "model_grade_checks"}  # test_metrics.py
    tested |= {"segment_precise", "segment_full", "segment_search"}  # test_segmentation.py
    tested |= {"rouge_l", "rouge_characters_l", "hybrid_search", "hyde_search", "near_dedup_greedy", "near_dedup_components", "near_dedup_minhash", "keywords_text_rank"}  # test_brute.py
    assert set(QUERIES) - set(ORACLES) == tested


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
