"""Queries with SQL give the rows that DuckDB gives for it."""

from __future__ import annotations

import duckdb
import pytest

from granary.llm import queries

from .helpers import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    wanted = sorted(map(str, result.df()[columns].itertuples(index=False, name=None)))
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == wanted
