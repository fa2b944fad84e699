"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same compare at sf0.01: ``tools/oracle_check.py``)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402

from landsight.registry.oracle import ORACLE  # noqa: E402
from landsight.registry.queries import QUERIES  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

# the library's own; the training-data operators have tests of their own
NAMES = sorted(QUERIES)


def test_every_query_has_oracle_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert digest(got) == digest(want)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[:2] == ["dataset", "year"]
