"""Array<double> math as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(arr) -> Column:
    return F.transform(_c(arr), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sequential left fold of the element products (same order as the oracle)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """dot / (|a| |b|); 0 when either norm is 0."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def neg_l2(a, b) -> Column:
    """-||a - b||."""
    d = F.zip_with(_c(a), _c(b), lambda x, y: x - y)
    return -F.sqrt(dot(d, d))


def rmse(pred, truth) -> Column:
    """sqrt(mean((p - t)^2)); NaN when the lengths differ; NULL when either is NULL."""
    p, t = _c(pred), _c(truth)
    d = F.zip_with(p, t, lambda x, y: x - y)
    sq = dot(d, d)
    return F.when(p.isNull() | t.isNull(), F.lit(None).cast("double")).when(
        F.size(p) != F.size(t), F.lit(float("nan"))).otherwise(F.sqrt(sq / F.size(p)))


def nan_mean(values: list[Column]) -> Column:
    """Mean of the non-NaN, non-NULL values; NaN when none."""
    arr = F.filter(F.array(*values), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(arr) == 0, F.lit(float("nan"))).otherwise(
        F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v) / F.size(arr))


def unit(a) -> Column:
    """a / |a| (zero vector stays zero) - normalise once per vector, then cosine = dot. The norm is bound once, not worked out for each number."""
    bound = F.array(F.struct(_c(a).alias("a"), norm(a).alias("n")))
    return F.transform(bound, lambda s: F.when(s["n"] == 0, F.transform(s["a"], lambda x: x * 0.0)).otherwise(
        F.transform(s["a"], lambda x: x / s["n"])))[0]
