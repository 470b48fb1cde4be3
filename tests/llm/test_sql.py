"""Queries of the subpackage against their DuckDB forms on the small tables."""

import duckdb
import pytest

from weftline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in rel.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert got == want
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string"}
    assert {d[0]: kinds.get(str(d[1])) for d in rel.description if str(d[1]) in kinds} == {d[0]: dict(df.dtypes)[d[0]] for d in rel.description if str(d[1]) in kinds}
