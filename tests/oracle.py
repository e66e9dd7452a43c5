"""Comparison of a query with its SQL, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb


def rows(records: list[dict]) -> list:
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[k]) for k in sorted(r)) for r in records), key=repr)


def same(spark, name, query, sql, root="/root/testdata/sf0.01"):
    db = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame, want = query(spark, root), db.sql(sql)
    assert sorted(frame.columns) == sorted(want.columns), name
    got, want = frame.toArrow().to_pylist(), want.to_arrow_table().to_pylist()
    assert rows(got) == rows(want), name
    return got
