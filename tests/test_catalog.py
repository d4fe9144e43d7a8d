import math
import os

import duckdb
import pytest

from weft import catalog

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in catalog.ORDER:
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_equals_sql(spark, db, name):
    df = catalog.run(name, spark, SF).df
    cursor = db.execute(catalog.QUERIES[name][1])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((plain([r[n] for n in order]) for r in df.collect()), key=str)
    want = sorted((plain([r[names.index(n)] for n in order]) for r in cursor.fetchall()), key=str)
    assert got == want
