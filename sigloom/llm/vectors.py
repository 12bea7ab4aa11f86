"""Shared steps of the vector operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def usable(vector: str = "embedding") -> Column:
    """True for vectors that are not null, not zero and hold finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame) -> DataFrame:
    """Usable rows with the vector as doubles and its length; -0.0 becomes 0.0."""
    doubles = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    return vectors.where(usable()).withColumn("embedding", doubles).withColumn("dim", F.size("embedding"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps the square sums finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
