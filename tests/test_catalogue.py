"""Every registered query against its DuckDB form on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from weftline.plans.catalogue import QUERIES

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    order = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    if sql is None:
        assert rows
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    want = [tuple(plain(r[k]) for k in at) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows.sort(key=key)
    want.sort(key=key)
    assert len(rows) == len(want)
    assert rows == want
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}
    types = dict(df.dtypes)
    for d in rel.description:
        have = str(d[1])
        assert kinds.get(have, have.lower()) == types[d[0]], (d[0], have, types[d[0]])


def test_files_hold_no_data():
    assert not glob.glob(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "**/*.parquet"), recursive=True)
