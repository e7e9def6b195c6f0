"""Runs a query in Spark and its SQL in DuckDB and compares their rows."""

from pathlib import Path

import duckdb


def views(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(columns, table):
    def text(v):
        return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[c]) for c in columns) for r in table)


def assert_same(spark, folder, query, sql):
    df = query(spark, folder)
    cursor = views(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    expected = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert rows(sorted(names), [r.asDict() for r in df.collect()]) == rows(sorted(names), expected)
