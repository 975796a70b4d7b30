"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(path := f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    """'' if they agree."""
    columns, rows = by_sql(sql, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    other = normal(columns, rows)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != other:
        extra, missing = [r for r in mine if r not in other][:3], [r for r in other if r not in mine][:3]
        return f"{len(mine)} and {len(other)} rows; only Spark: {str(extra)[:700]}; only SQL: {str(missing)[:700]}"
    return ""
