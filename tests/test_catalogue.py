"""Every query with SQL gives DuckDB's rows on the small tables; the others give rows."""

from __future__ import annotations

import pytest

from tallyframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(name, spark, compare):
    if name in SQL:
        own, other = compare(Q[name], SQL[name], DATA)
        assert own == other
    else:
        assert Q[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)
    assert len(rows) == 5
