"""Numbers and vectors as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column, digits: int = 4) -> Column:
    """n / d rounded, 0 where d is 0."""
    return F.coalesce(F.round(F.try_divide(n.cast("double"), d), digits), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; 0 if a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def recency_mean(values: Column, decay: float) -> Column:
    """Mean with weight exp(-decay * age), the last value of age 0; null for an empty array."""
    weighted = F.transform(F.reverse(values), lambda x, i: F.struct((F.exp(-decay * i) * x).alias("x"), F.exp(-decay * i).alias("w")))
    total = lambda f: F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v[f])
    return F.try_divide(total("x"), total("w"))


def harmonic_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.when((a <= 0) | (b <= 0) | (c <= 0), 0.0).otherwise(3 / (1 / a + 1 / b + 1 / c))


def upper_median(values: Column) -> Column:
    """Element n // 2 of the ascending values."""
    ordered = F.sort_array(values)
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def gain(relevance: Column, rank: Column) -> Column:
    """Discounted gain of a graded hit."""
    return relevance / (F.log(rank + F.lit(1.0)) / math.log(2))
