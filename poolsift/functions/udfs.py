"""User functions callable from SQL.

``trapz(array<double>)`` is kept for users who call it from SQL over a
collected curve; the library's own plans compute running areas with window
sums instead (see ``operators.curves``).  It is an Arrow-batched pandas UDF,
never a row-at-a-time Python function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def trapz(values: pd.Series) -> pd.Series:
    """Trapezoid rule with unit spacing; 0 for NULL, empty and one-point lists."""
    lists = [np.empty(0) if v is None else np.asarray(v, dtype=np.float64) for v in values]
    n = np.array([len(v) for v in lists], dtype=np.int64)
    flat = np.concatenate([*lists, np.zeros(1)])
    first = np.cumsum(n) - n
    total = np.concatenate([[0.0], np.cumsum(flat)])
    area = total[first + n] - total[first] - (flat[first] + flat[np.maximum(first + n - 1, 0)]) / 2.0
    return pd.Series(np.where(n > 1, area, 0.0))


def register_trapz(spark: SparkSession, name: str = "trapz") -> None:
    spark.udf.register(name, trapz)
