"""Functions that Spark lacks."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float, steps: int = 300) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x, steps)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(steps):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_test_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.arrow_udf(DoubleType())
def _pearson_p(r: pa.Array, n: pa.Array) -> pa.Array:
    def one(a, k):
        if a is None or math.isnan(a) or k < 3:
            return None
        return 0.0 if abs(a) >= 1 else t_test_p(a * math.sqrt((k - 2) / (1 - a * a)), k - 2)

    return pa.array([one(a, k) for a, k in zip(r.to_pylist(), n.to_pylist())], pa.float64())


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs; runs on aggregated rows, of which there are as many as groups."""
    return _pearson_p(r.cast("double"), n.cast("long"))
