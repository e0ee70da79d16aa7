"""Every training-data query that has SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from textquarry.llm import queries

SF = "/root/testdata/sf0.001"


def shown(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, SF)
    assert shown(df.columns, df.collect()) == shown(columns, want.fetchall())
