"""Compares a query with its SQL, run by DuckDB over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def check(spark, folder, query, sql):
    got = query(spark, folder).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    order = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    got, want = order(got), order(want)
    for c in columns:
        assert (got[c].values == want[c].values).all(), c
