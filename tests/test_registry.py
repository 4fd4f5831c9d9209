"""Every query with SQL gives the rows that DuckDB gives for it; the others run."""

from __future__ import annotations

import math

import duckdb
import pytest

from granary.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v + 0.0 if isinstance(v, float) and v == 0 else v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert df.columns
        return
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert told(rows, df.columns) == told(result.fetchall(), columns)
