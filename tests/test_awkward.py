"""Every civic query over empty tables, and over tables with nulls in every column, ties and repeated rows."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import differences

from civicrill import catalogue

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
#: The total of an empty cube: SQL has a row for it, Spark has none.
NO_TOTAL = {"company_overview"}


def tables(folder, change):
    for f in os.listdir(SMALL):
        if f.endswith(".parquet"):
            t = pq.read_table(f"{SMALL}/{f}")
            pq.write_table(change(t), f"{folder}/{f}")
    return str(folder)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), lambda t: t.slice(0, 0))


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    rng = random.Random(4)

    def change(t):
        rows = t.slice(0, min(len(t), 120)).to_pylist()
        nulls = [{**r, c: None} for c in t.column_names for r in rng.sample(rows, min(3, len(rows)))]
        return pa.Table.from_pylist([*rows, *rows[:5], *nulls, dict.fromkeys(t.column_names)], schema=t.schema)

    return tables(tmp_path_factory.mktemp("awkward"), change)


def test_empty_tables(spark, empty):
    bad = {n: d for n in sorted(catalogue.ORACLE) if n not in NO_TOTAL and (d := differences(spark, empty, catalogue.QUERIES[n], catalogue.ORACLE[n]))}
    assert bad == {} and all(catalogue.QUERIES[n](spark, empty).collect() == [] for n in NO_TOTAL)


def test_nulls_ties_and_repeated_rows(spark, awkward):
    """No query fails, whatever is null."""
    for n in sorted(catalogue.QUERIES):
        df = catalogue.QUERIES[n](spark, awkward)
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns), n


#: Queries of one key whose results the nulls and repeated rows must not change, against their SQL.
EXACT = ("vote_totals", "parsing_coverage", "certainty_statistics", "weakest_link", "planning_changes", "reasonable_dates", "personal_keys", "area_discovery", "same_meeting", "suffix_duplicates", "budget_triples", "two_layouts", "source_states", "issue_completeness", "date_steps", "dates_in_text", "section_values", "proposals", "pair_output", "minutes_headers", "minutes_resolutions", "departments")


@pytest.mark.parametrize("name", EXACT)
def test_awkward_rows_equal_sql(spark, awkward, name):
    assert differences(spark, awkward, catalogue.QUERIES[name], catalogue.ORACLE[name]) == ""
