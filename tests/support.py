"""Comparison of results regardless of row and column order."""

import math

import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, (tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))))


def listed(df) -> list:
    """Rows of a DataFrame as sorted tuples, in column order."""
    return sorted((tuple(r) for r in df.collect()), key=str)
