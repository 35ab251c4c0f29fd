"""Plans stay free of joins that compare all with all, and scans read what they need."""

import re

import pytest

from pixelloom.plans import catalogue_queries, registry

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_joins_all_with_all(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "column"), [("pred4_manual", "class_rule"), ("pred5_moves", "op"), ("o3_review_queue", "class_rule"), ("k7_label_export", "class_rule")])
def test_filters_reach_the_scan(spark, sf, name, column):
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(QUERIES[name](spark, sf)))[1]
    assert f"({column}" in pushed


def test_only_needed_columns_are_read(spark, sf):
    assert "ReadSchema: struct<path:string,size:bigint,mtime:bigint>" in plan(QUERIES["s16_index_state"](spark, sf))
    assert "exif" not in re.sub(r".*ReadSchema: ", "", plan(QUERIES["o5_organize_plan"](spark, sf)), count=1, flags=re.S)[:200]


def test_the_review_queue_is_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["o3_review_queue"](spark, sf))


def test_every_query_has_a_docstring_or_oracle():
    assert set(catalogue_queries.QUERIES) == set(catalogue_queries.ORACLES)
