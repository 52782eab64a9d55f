"""Array algebra for scoring: columns of array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.graph import dot


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(slope * x)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def scale(x: Column, f: Column) -> Column:
    return F.transform(x, lambda a: a * f)


def masked_softmax(scores: Column, mask: Column) -> Column:
    """Weights of the elements whose mask is set, 0 for the others; all 0 without any."""
    shown = F.zip_with(scores, mask, lambda s, m: F.when(m, s))
    top = F.array_max(F.filter(shown, lambda s: s.isNotNull()))
    e = F.transform(shown, lambda s: F.when(s.isNull(), F.lit(0.0)).otherwise(F.exp(s - top)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: F.when(total > 0, v / total).otherwise(F.lit(0.0)))


def gate(own: Column, other: Column, logit: Column) -> Column:
    g = sigmoid(logit)
    return F.zip_with(own, other, lambda a, b: g * a + (1 - g) * b)


def visual_score(user: Column, item: Column, user_visual: Column, visual: Column, mask: Column) -> Column:
    """Dot product plus the visual one where an image is there."""
    return dot(user, item) + F.when(mask, dot(user_visual, visual)).otherwise(0.0)


def bpr_loss(positive: Column, negative: Column) -> Column:
    return softplus(negative - positive)
