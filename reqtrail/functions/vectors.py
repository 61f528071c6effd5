"""Vector measures on array columns, in double precision inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(wide(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """v over its length; a vector of length 0 becomes null numbers rather than an error."""
    return F.transform(F.arrays_zip(wide(v).alias("x")), lambda e: F.try_divide(e["x"], norm(v)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y))))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def polynomial(a: Column, b: Column) -> Column:
    return F.pow(F.lit(0.5) * dot(a, b) + 1, F.lit(2.0))


def sigmoid(a: Column, b: Column) -> Column:
    """tanh(a.b + 1): the measure keeps its usual name."""
    return F.tanh(dot(a, b) + 1)


def euclidean(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance(a, b))


def gesd(a: Column, b: Column) -> Column:
    return euclidean(a, b) * logistic(dot(a, b) + 1)


def aesd(a: Column, b: Column) -> Column:
    return (euclidean(a, b) + logistic(dot(a, b) + 1)) * 0.5


MEASURES = {"cos": cosine, "poly": polynomial, "sigmoid": sigmoid, "euc": euclidean, "gesd": gesd, "aesd": aesd}


def similarity(a: Column, b: Column, measure: str = "cos") -> Column:
    """Similarity of two rows. Every measure is taken row by row."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known: {sorted(MEASURES)}")
    return MEASURES[measure](a, b)


def hinge(positive: Column, negative: Column, margin: float) -> Column:
    """Loss of one row: at least 1e-6. Its mean is the model's loss."""
    return F.greatest(F.lit(float(margin)) - positive + negative, F.lit(1e-6))


def word_weight(ident: Column) -> Column:
    """1 - exp(-id); padding (0) weighs 0."""
    return F.lit(1.0) - F.exp(-ident.cast("double"))


def learning_rate(step: Column, warm_up: int, steps: int, cycles: float = 0.5) -> Column:
    """Factor that rises in a line over the warm-up and then falls along a half cosine, at least 0."""
    rise = step.cast("double") / max(1.0, float(warm_up))
    done = (step - warm_up).cast("double") / max(1.0, float(steps - warm_up))
    return F.when(step < warm_up, rise).otherwise(F.greatest(F.lit(0.0), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi * cycles * 2.0) * done))))


def max_pool(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """For each id the largest value of each dimension over its vectors, padding included."""
    each = rows.select(ident, F.posexplode(wide(F.col(vector))).alias("dim", "value"))
    return each.groupBy(ident, "dim").agg(F.max("value").alias("value"))
