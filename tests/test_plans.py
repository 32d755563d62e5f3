"""What the plans must look like at any size."""

from __future__ import annotations

import os

import pytest

from webloom.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_everything_with_everything(spark, name) -> None:  # noqa: ANN001
    p = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize(("name", "columns", "filters"), [("w3_time_to_live", {"url", "fetched_at"}, "IsNotNull(url)"), ("s3_source_kinds", {"url"}, "IsNotNull(url)"), ("c7", {"doc_id", "text"}, "IsNotNull(text)")])
def test_scans_read_only_what_is_asked(spark, name, columns, filters) -> None:  # noqa: ANN001
    p = plan(QUERIES["c15_tokens_and_hash" if name == "c7" else name](spark, DATA))
    schema = p.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert {c.split(":")[0] for c in schema.split(",")} == columns and filters in p


def test_texts_are_not_shuffled_for_counts(spark) -> None:  # noqa: ANN001
    p = plan(QUERIES["a1_word_stats"](spark, DATA))
    assert "Exchange" not in p


def test_no_python_where_expressions_do(spark) -> None:  # noqa: ANN001
    for name in ("d1_html_to_text", "a2_readability", "c12_language", "c2_normalize_crawl", "f1_filter_chain", "f17_blocked", "r12_url_scores", "h3_windows", "u2_line_diff"):
        p = plan(QUERIES[name](spark, DATA))
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p, name
