"""Array-of-number expressions: norms, normalisation, argmax, softmax, hyperbolic distance."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the norm floor of L2 normalisation.
L2_EPS = 1e-12


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def sq_norm(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x)


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def l2_normalise(v, dtype: str = "float") -> Column:
    """``x / max(||x||, 1e-12)``."""
    v = _col(v)
    n = F.greatest(norm(v), F.lit(L2_EPS))
    return F.transform(v, lambda x: (x.cast("double") / n).cast(dtype))


def argmax(v) -> Column:
    """0-based index of the first maximum."""
    v = _col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v) -> Column:
    """Max-shifted softmax in double precision."""
    v = _col(v)
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x.cast("double") - m))
    s = F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def sq_dist(u, v) -> Column:
    d = F.zip_with(_col(u), _col(v), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda a, x: a + x)


def poincare_distance(u, v) -> Column:
    """``acosh(1 + 2||u-v||^2 / ((1-||u||^2)(1-||v||^2)))``."""
    num = 2 * sq_dist(u, v)
    den = (1 - sq_norm(u)) * (1 - sq_norm(v))
    return F.acosh(1 + num / den)


def has_nan(v) -> Column:
    return F.exists(_col(v), lambda x: F.isnan(x))
