"""The registered text queries on the smallest tables, against DuckDB where there is SQL."""

import duckdb
import pytest

from tracequarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    if name not in queries.ORACLE_SQL:
        assert got
        return
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(x) for x in columns]
    assert sorted(names) == columns and got == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
