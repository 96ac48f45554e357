"""Comparison of a query with its SQL in DuckDB, regardless of row and column order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        at = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from '{at}'")
    return con


def _cell(value: object) -> str:
    if value is None or value is pd.NA or value != value:
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0) if value % 1 else str(int(value))
    return str(int(value)) if type(value).__name__ in ("bool", "bool_") else str(value)


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return list(frame.columns), sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False, name=None))
