"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from tracelake.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.6g}"
    return str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    found = catalog.QUERIES[name](spark, DATA)
    names = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    if name not in catalog.SQL:
        assert rows
        return
    db = duckdb.connect()
    for table in os.listdir(DATA):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    want = db.execute(catalog.SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == names
    assert rows == sorted(tuple(plain(r[order.index(c)]) for c in names) for r in want.fetchall())
