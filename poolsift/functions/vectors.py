"""Vector and logit expressions on ``ARRAY<DOUBLE>`` columns.

All JVM-side higher-order functions, so they stay inside whole-stage codegen
and never cross into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(c) -> Column:
    return F.transform(_col(c), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1 if either vector has norm zero, NULL if either is NULL."""
    n = norm(a) * norm(b)
    return F.lit(1.0) - F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def _exp_sum(logits: Column, m: Column) -> Column:
    return F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - m))


def logsumexp(logits) -> Column:
    lg = _col(logits)
    m = F.array_max(lg)
    return m + F.ln(_exp_sum(lg, m))


def softmax(logits) -> Column:
    lg = _col(logits)
    m = F.array_max(lg)
    s = _exp_sum(lg, m)
    return F.transform(lg, lambda x: F.exp(x - m) / s)


def entropy(logits) -> Column:
    """Shannon entropy (nats) of softmax(logits), computed stably."""
    lg = _col(logits)
    m = F.array_max(lg)
    s = _exp_sum(lg, m)
    t = F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m) * (x - m))
    return F.ln(s) - t / s


def argmax(logits) -> Column:
    """0-based index of the first maximum."""
    lg = _col(logits)
    return (F.array_position(lg, F.array_max(lg)) - F.lit(1)).cast("int")


def max_prob(logits) -> Column:
    """Top-class confidence max(softmax(logits)) = 1 / sum(exp(x - max))."""
    lg = _col(logits)
    return F.lit(1.0) / _exp_sum(lg, F.array_max(lg))
