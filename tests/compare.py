"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA:
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return "NULL" if np.isnan(value) else f"{value:.9g}"
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def _rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in got.columns:
        # integers with nulls are floats in the one frame and nullable integers in the other
        if isinstance(want[c].dtype, pd.Int64Dtype) and got[c].dtype.kind == "f":
            got = got.assign(**{c: got[c].astype("Int64")})
        a, b = got[c].dtype.kind, want[c].dtype.kind
        if a != b and not {a, b} <= {"i", "u"} and not (len(got) == 0):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    for mine, theirs in zip(_rows(got), _rows(want)):
        if mine != theirs:
            return f"row {mine} != {theirs}"
    return None
