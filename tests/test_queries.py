"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from ledgerlens import plans

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in SF.iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return norm(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    df = plans.QUERIES[name](spark, str(SF))
    rows = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert rows
    if name not in plans.SQL:
        return
    found = sql.sql(plans.SQL[name])
    at = [found.columns.index(c) for c in sorted(df.columns)]
    assert len(found.columns) == len(df.columns)
    assert rows == sorted(repr([norm(r[i]) for i in at]) for r in found.fetchall())
