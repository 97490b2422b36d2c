"""Cosine of array columns in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _stacked(s: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the right length as one matrix, which rows those are)."""
    ok = s.map(lambda v: v is not None and len(v) == dim).to_numpy(bool)
    return (np.stack(s[ok].to_numpy()).astype(np.float64) if ok.any() else np.zeros((0, dim))), ok


def cosine_to(vec: Column, query: list[float]) -> Column:
    """Cosine of each vector with one query, in double precision; null for null, zero and other lengths. One product of a matrix
    and a vector for each batch, where built-in higher-order functions interpret every element."""
    q = np.asarray(query, np.float64)
    norm = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        x, ok = _stacked(s, len(q))
        n = np.linalg.norm(x, axis=1) * norm
        c = np.full(len(s), np.nan)
        c[ok] = np.divide(x @ q, n, out=np.full(len(x), np.nan), where=n > 0)
        return pd.Series(c).astype(object).where(~np.isnan(c), None)

    return run(vec)
