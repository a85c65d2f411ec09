"""Every query against its SQL on the smallest data; those without SQL must run."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import rows_of_spark, rows_of_sql

DATA = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if not n.startswith(("p2_", "p4_", "p5_", "p6_", "p7_", "p8_", "p9_"))]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    got = rows_of_spark(entry.queries()[name](spark, DATA))
    sql = entry.oracle_sql().get(name)
    if sql:
        assert got == rows_of_sql(DATA, sql)
    else:
        assert got[0]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
