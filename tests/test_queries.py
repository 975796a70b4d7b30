"""Every registered query that has SQL agrees with it; the others run."""

from __future__ import annotations

import pytest

import __spark_entry__
from tessera import plans
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    assert not differences(plans.QUERIES[name](spark, sf_dir), plans.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    hits = __spark_entry__.entry(spark)
    assert hits.count() == 10
    assert "similarity" in hits.columns


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
