"""Runs a registered query and its SQL twin and compares the rows."""

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    if len(got) == 0:
        return None if len(want.columns) else "no columns"
    got, want = normal(got), normal(want)
    for c in got:  # whole numbers with nulls are floating point on one side
        if str(got[c].dtype) == "float64" and str(want[c].dtype) == "Int64":
            got[c] = got[c].astype("Int64")
    types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got if got[c].dtype != want[c].dtype]
    if types:
        return f"types {types}"
    differ = [c for c in got if not (got[c].equals(want[c]) or (got[c] == want[c]).all())]
    return f"values differ in {differ}" if differ else None
