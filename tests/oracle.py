"""Runs a query and its SQL on the same Parquet tables and compares rows."""

from pathlib import Path

import duckdb


def _rows(frame):
    columns = sorted(frame)
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(map(tuple, values), key=str)


def assert_same(query, sql, spark, sf):
    ours = query(spark, sf).toPandas()
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    theirs = con.execute(sql).df()
    assert _rows(ours) == _rows(theirs)
