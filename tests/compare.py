"""Rows of a query against its SQL in DuckDB, in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


def same(spark, query, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
