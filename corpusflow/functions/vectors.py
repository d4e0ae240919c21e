"""Dense vector math on ``array<float|double>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import _c


def _d(x):
    return x.cast("double")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + _d(x) * _d(x)))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a one-element ``transform``)."""
    return F.get(F.transform(F.array(value), fn), 0)


def l2_normalize(a) -> Column:
    """Unit-length copy in double; a zero vector becomes NULL (no direction)."""
    bound = F.struct(_c(a).alias("v"), norm(a).alias("n"))
    return let(bound, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: _d(x) / s["n"])))


def cosine_distance(a, b) -> Column:
    """``1 - a.b / (|a| |b|)``; NULL when either vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance) -> Column:
    """Score shown to users: ``max(0, 1 - distance)``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - _c(distance))
