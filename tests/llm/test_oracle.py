"""The queries that SQL can express, against DuckDB on whole small tables."""

import duckdb
import pytest

from veritally.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(ORACLE_SQL[name]).project(", ".join(cols)).fetchall()
    rounded = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert rounded(map(tuple, df.select(*cols).collect())) == rounded(want)
