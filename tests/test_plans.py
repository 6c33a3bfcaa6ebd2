"""Every civic query against its SQL over the smallest tables; test_awkward.py has empty tables and awkward rows."""

import json

import pytest
from compare import differences

from civicrill import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, SMALL, catalogue.QUERIES[name], catalogue.ORACLE[name]) == ""


def test_every_query_has_a_name_that_sql_answers():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_filters_and_columns_reach_the_scan(spark):
    """The flagship reads the columns that it needs and no more."""
    plan = catalogue.QUERIES[catalogue.FLAGSHIP](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "c_mktsegment" not in plan


def test_entry_is_importable_and_serialisable():
    import __spark_entry__

    names = sorted(__spark_entry__.queries())
    assert json.loads(json.dumps(names)) == names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
