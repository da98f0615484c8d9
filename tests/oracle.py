"""Runs a registered query and its DuckDB SQL and compares columns and rows, order aside."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v) -> str:
    if isinstance(v, (float, np.floating)):
        return repr(float(v) + 0.0)
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA / sf / f'{t}.parquet'}'")
    return con


def rows(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


def agree(spark, con, query, sql: str, sf: str) -> None:
    df = query(spark, str(DATA / sf))
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())
