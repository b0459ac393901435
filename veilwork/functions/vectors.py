"""Vector and probability columns as higher-order functions; for small joins and row-wise work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    d = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return _sum(F.zip_with(a, b, d))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    e = F.transform(a, lambda x: F.exp((x.cast("double") - F.array_max(a).cast("double")) / temperature))
    return F.transform(e, lambda x: x / _sum(e))


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / temperature))


def entropy(p: Column, bits: bool = False) -> Column:
    """Zero probabilities add nothing."""
    log = F.log2 if bits else F.log
    return -_sum(F.transform(p, lambda x: F.when(x > 0, x * log(x)).otherwise(0.0)))


def argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def error_and_confidence(prob: Column, label: Column) -> dict[str, Column]:
    p = F.element_at(prob, label.cast("int") + 1)
    return {
        "error": F.abs(1 - p),
        "confidence": p,
        "correct": argmax(prob) == label,
        "cross_entropy": -F.log(p),
    }
