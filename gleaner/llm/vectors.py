"""Reading vector columns: which rows count, and packing them for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and every component is finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """The usable rows with their vector as array<double>, in ``v``."""
    return df.where(usable(F.col(vec))).withColumn("v", F.col(vec).cast("array<double>"))


def matrix(column) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    return np.array([np.asarray(x, dtype=np.float64) for x in column], dtype=np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out
