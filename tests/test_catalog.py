"""Every registered log query against its SQL."""

import os

import duckdb
import pytest

from logbrook.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    theirs = sorted((tuple(row[order.index(c)] for c in columns) for row in cursor.fetchall()), key=str)
    assert sorted(order) == columns and mine == theirs


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
