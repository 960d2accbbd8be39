"""Distances of array columns, and closed-form losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def focal_loss(p: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of a probability, clipped away from 0 and 1, against a label 0 or 1."""
    held = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
    right = F.when(label == 1, held).otherwise(1 - held)
    return -F.when(label == 1, F.lit(alpha)).otherwise(1 - F.lit(alpha)) * (1 - right) ** gamma * F.log(right)


def anneal(step: Column, start_step: float, end_step: float, start: float, end: float) -> Column:
    """start up to start_step, end from end_step, linear between."""
    share = F.least(F.greatest((step - start_step) / (end_step - start_step), F.lit(0.0)), F.lit(1.0))
    return start + share * (end - start)


def gaussian_kl(log_variance: Column) -> Column:
    """KL divergence of N(mu, exp(log_variance)) from N(mu, 1), summed over an array."""
    return _sum(F.transform(log_variance, lambda v: 0.5 * (F.exp(v) - v - 1)))
