"""Compares a query with its SQL: sorted columns, sorted rows, the same values."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with a view for each table."""
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else path / '*.parquet'}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dt.datetime):
        return x.isoformat()
    return str(x) if isinstance(x, dt.date) else x


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns in order and rows in order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
