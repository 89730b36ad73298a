"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()
MINE = sorted(n for n in SQL if not n.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return f"{x:.6g}"
        return "NULL" if x is None else str(x) if not hasattr(x, "as_integer_ratio") or isinstance(x, bool) else f"{float(x):.6g}"

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", MINE)
def test_query_gives_what_sql_gives(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert plain(want.fetchall(), names) == plain(found.collect(), found.columns)
