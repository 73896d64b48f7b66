"""The driver's contract: names, matching oracles, and queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 40
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, sf_dir, duck, name):
    own, other = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns) and len(own) == len(other)
    # rows are matched by all columns that are no measured numbers
    keys = [c for c in own.columns if own[c].dtype.kind != "f" and other[c].dtype.kind != "f"]
    text = lambda x: x.astype(str).str.replace(r"( 00:00:00)?$", "", regex=True).where(x.notna(), "")
    own, other = (df[sorted(df.columns)].assign(**{k: text(df[k]) for k in keys}) for df in (own, other))
    if keys:
        own, other = (df.sort_values(keys).reset_index(drop=True) for df in (own, other))
    for c in own.columns:
        if own[c].dtype.kind == "f" or other[c].dtype.kind == "f":
            a, b = own[c].astype(float), other[c].astype(float)
            assert (((a - b).abs() <= 1.01e-6) | (a.isna() & b.isna())).all(), c
        else:
            assert own[c].tolist() == other[c].tolist(), c
