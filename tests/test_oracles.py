from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratagrid.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        at = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    found = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and all(r.superset for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(registry.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
