"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal_form(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].dt.date
        pdf[c] = pdf[c].map(lambda v: None if pd.isna(v) else
                            (repr(float(v)) if isinstance(v, float) else str(v)))
    return pdf.sort_values(list(pdf.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both hold the same columns and rows in any order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    a, b = normal_form(got), normal_form(want)
    if a.equals(b):
        return ""
    bad = (a != b) & ~(a.isna() & b.isna())
    row = bad.any(axis=1).idxmax()
    return (f"{int(bad.any(axis=1).sum())} rows differ, first: "
            + ", ".join(f"{c}: {a.at[row, c]} != {b.at[row, c]}" for c in a.columns if bad.at[row, c]))
