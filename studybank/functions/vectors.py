"""Vector expressions on ``array<float>`` columns.

All of them are native higher-order functions (``aggregate``/``zip_with``/
``transform``) so they stay inside whole-stage codegen; arithmetic is done in
double and only the final value is narrowed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product of two equal-length arrays, accumulated in double."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def norm(a) -> Column:
    """Euclidean length, accumulated in double."""
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(a, element_type: str = "float") -> Column:
    """v / ||v||; a zero vector stays all zeros instead of turning into NaN."""
    n = norm(a)
    return F.transform(
        _col(a),
        lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast(element_type),
    )


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side has zero length."""
    denom = norm(a) * norm(b)
    return F.when(denom > 0, dot(a, b) / denom).otherwise(F.lit(0.0))


def dims(a) -> Column:
    """Vector width (used to check that a bank has one width)."""
    return F.size(_col(a))
