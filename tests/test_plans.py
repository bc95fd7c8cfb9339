"""The shape of plans: what is pruned, pushed down, kept out of Python and limited before a shuffle."""

import pytest

from tessellar.plans import ledger, retrieval, text


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bm25_is_native_and_reads_needed_columns(spark, sf):
    shown = plan(retrieval.bm25_topk(spark, sf))
    assert "Python" not in shown and "Arrow" not in shown
    assert "n_chars" not in shown
    assert "WindowGroupLimit" in shown


def test_knn_limits_before_the_shuffle(spark, sf):
    shown = plan(retrieval.knn_cosine_topk(spark, sf))
    assert "WindowGroupLimit" in shown and "Python" not in shown


def test_filters_reach_the_scan(spark, sf):
    shown = plan(ledger.latency_percentiles(spark, sf))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,0.0)]" in shown
    assert "props" not in shown


@pytest.mark.parametrize("query", [text.injection_scan, text.intent_kinds, text.url_dedupe, text.clean_text])
def test_text_functions_are_native(spark, sf, query):
    shown = plan(query(spark, sf))
    assert "Python" not in shown and "Arrow" not in shown
