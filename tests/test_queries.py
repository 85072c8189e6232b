"""Every named query against its SQL in another engine: rows, names and types."""

import duckdb
import pytest

from larkspur.plans import catalogue
from larkspur.session import TABLES

DATA = "/root/testdata/sf0.001"
#: Queries whose result on so little data may be empty.
SPARSE = {"cte_column_names", "tpch_q2", "tpch_q5", "subquery_exists", "window_range_frame"}


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def kind(t):
    return str(t).replace("large_", "")


def rows(table, names):
    return sorted(tuple("NULL" if v is None else repr(v) for v in r.values()) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, other, name):
    got = catalogue.queries()[name](spark, DATA).toArrow()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows
        return
    want = other.sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    assert [kind(got.schema.field(n).type) for n in names] == [kind(want.schema.field(n).type) for n in names]
    assert rows(got, names) == rows(want, names)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
