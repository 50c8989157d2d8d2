"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

_SQL = entry.oracle_sql()


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def _norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 4)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(_SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    made = sorted(repr([_norm(x) for x in r]) for r in df.select(*cols).collect())
    rel = con.sql(_SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted(repr([_norm(r[i]) for i in order]) for r in rel.fetchall())
    assert made == want


def test_nothing_outside_imports_the_llm_folder():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for p in glob.glob(f"{root}/quirelake/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "llm" not in open(p).read().replace("llm_", ""), p
