"""Runs SQL over the generated tables and compares rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sql_rows(sql: str, sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def sorted_rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(str, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)))


def same(ours, theirs) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = sorted_rows(ours), sorted_rows(theirs)
    assert len(a) == len(b)
    assert a == b
