"""Every query of the catalogue beside its SQL."""

import pytest

from lorebase import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, same):
    same(name, queries.QUERIES, queries.ORACLES)


def test_entry_runs_without_the_llm_folder(spark, data):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert {r["page_type"] for r in rows} >= {"papers", "concepts", "theories", "methods", "overviews", "questions"}


def test_plans(spark, data):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(queries.QUERIES["search_topk"](spark, data))
    text = plan(queries.QUERIES["dedup_first_match"](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    scan = plan(queries.QUERIES["project_keywords"](spark, data))
    assert "text:string" not in scan
