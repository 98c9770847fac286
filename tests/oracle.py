"""Compare registered queries with their SQL on DuckDB, row by row."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def _bag(rows, order) -> Counter:
    return Counter(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    theirs = result.fetchall()
    names = spark_df.columns
    if sorted(names) != sorted(theirs_names):
        return f"columns {sorted(names)} != {sorted(theirs_names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    bad = {
        f.name: (f.dataType.simpleString(), types[f.name])
        for f in spark_df.schema
        if not same_type(f.dataType.simpleString(), types[f.name])
    }
    if bad:
        return f"types {bad}"
    mine = [tuple(r) for r in spark_df.collect()]
    order = sorted(names)
    left = _bag(mine, [names.index(n) for n in order])
    right = _bag(theirs, [theirs_names.index(n) for n in order])
    if left == right:
        return None
    only_l, only_r = left - right, right - left
    return (
        f"{order}: rows {len(mine)} vs {len(theirs)}; {sum(only_l.values())} only in Spark, e.g. "
        f"{sorted(only_l, key=str)[:2]}; {sum(only_r.values())} only in SQL, e.g. {sorted(only_r, key=str)[:2]}"
    )


_SAME = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def same_type(spark_type: str, duck_type: str) -> bool:
    return _SAME.get(spark_type) == duck_type
