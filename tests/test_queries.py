"""Every registered query of the page and session operators against its SQL."""

import pytest

import __spark_entry__
from tidemark.plans import MODULES

QUERIES, SQL = ({k: v for m in MODULES for k, v in getattr(m, name).items()} for name in ("QUERIES", "SQL"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_sql_gives(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_all_are_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_python_free_queries_stay_in_the_jvm(spark, sf_dir):
    for name in ("page_candidates", "snapshot_diff", "intern_placeholders", "ttl_sessions", "companion_states", "round_out"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["last_five_turns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>" in plan
