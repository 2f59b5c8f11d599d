"""Vector expressions in doubles; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    """A query vector, quantised to float32 like the stored ones."""
    return F.array(*[F.lit(float(x)) for x in np.asarray(values, dtype=np.float32)]).cast("array<double>")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null where either is null or the lengths differ."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or all zero, or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def score(distance: Column) -> Column:
    """1 for distance 0, falling towards 0."""
    return 1.0 / (1.0 + distance)


def is_valid(embedding: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite values; false for null."""
    finite = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dim) & finite, F.lit(False))
