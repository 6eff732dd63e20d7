"""Comparing a query with its SQL in DuckDB on one folder of tables."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([str([(columns[i], _plain(r[i])) for i in order]) for r in rows])


def check(spark, query, sql, sf_dir):
    """Compares on a folder, and where that gives no rows, which would prove nothing, on the next larger one."""
    for d in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        want = con.execute(sql)
        columns, expected = [c[0] for c in want.description], want.fetchall()
        if expected:
            break
    assert expected, "an empty result proves nothing"
    made = query(spark, d)
    assert sorted(made.columns) == sorted(columns)
    assert _rows(made.columns, [tuple(r) for r in made.collect()]) == _rows(columns, expected)
