"""Distances and simplex operations on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def poisson_dist(p: Column, q: Column, eps: float = EPS) -> Column:
    """Sum of (p - q) ln((p + eps) / (q + eps)): symmetric, 0 for equal arrays."""
    return _sum(F.zip_with(p, q, lambda a, b: (a - b) * F.log((a + eps) / (b + eps))))


def poisson_ll_2(p: Column, q: Column, eps: float = EPS) -> Column:
    return _sum(F.zip_with(p, q, lambda a, b: -(b + eps) + (a + eps) * F.log(b + eps)))


def symmetric_kld(p: Column, q: Column, eps: float = EPS) -> Column:
    """In bits, both directions added."""
    return _sum(F.zip_with(p, q, lambda a, b: a * F.log2(a / (b + eps) + eps) + b * F.log2(b / (a + eps) + eps)))


def jensen_shannon(p: Column, q: Column, eps: float = EPS) -> Column:
    """In bits, both directions added without halving; 0 log 0 is 0."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return _sum(F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2 + eps) + part(b, (a + b) / 2 + eps)))


def normalized(w: Column) -> Column:
    """Scaled to sum 1; an array that sums to 0 stays."""
    total = _sum(w)
    return F.when(total == 0, w).otherwise(F.transform(w, lambda v: v / total))


def argmax(w: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")


def relu(v: Column) -> Column:
    return F.greatest(F.lit(0.0), v)


def soft_one_hot(label: Column, k: int, weight: float = 0.75) -> Column:
    """``weight`` for the label's component, the rest shared equally; with one component it has all."""
    rest = (1 - weight) / (k - 1) if k > 1 else 0.0
    own = weight if k > 1 else 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(j == label, F.lit(own)).otherwise(F.lit(rest)))
