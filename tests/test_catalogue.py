"""Every query of the catalogue against its SQL in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerspark.plans import catalogue, more, postings, rules, state  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted((tuple(flat(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(catalogue.ORACLES[name])
    assert got == rows([c[0] for c in res.description], res.fetchall())
    assert got[1] or name in ("notify_picks",)
