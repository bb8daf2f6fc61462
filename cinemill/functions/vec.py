"""Vectors as arrays of numbers, computed in double precision inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def doubles(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """(1 - cos) / 2 in [0, 1]; 0 for NULL, empty, unlike or (nearly) zero vectors."""
    a, b = _c(a), _c(b)
    size = norm(a) * norm(b)
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) >= 1e-10) & (norm(b) >= 1e-10)
    return F.coalesce(F.when(good, F.least(F.greatest((1 - dot(a, b) / size) / 2, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))


def euclidean(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def euclidean_distance(a, b, longest: float = 10.0) -> Column:
    """Euclidean distance as a share of ``longest``, at most 1; 0 for NULL, empty or unlike vectors."""
    a, b = _c(a), _c(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.least(euclidean(a, b) / longest, F.lit(1.0))), F.lit(0.0))


def correlation(a, b) -> Column:
    """Pearson's correlation of two arrays, from five sums; NULL if one is constant."""
    a, b = _c(a), _c(b)
    n = F.size(a).cast("double")
    sa, sb = total(a), total(b)
    va, vb = n * dot(a, a) - sa * sa, n * dot(b, b) - sb * sb
    return F.when((va > 1e-12) & (vb > 1e-12), (n * dot(a, b) - sa * sb) / F.sqrt(va * vb))


def correlation_distance(a, b) -> Column:
    """1 - max(0, correlation), in [0, 1]."""
    return F.least(F.greatest(1 - F.greatest(F.lit(0.0), F.coalesce(correlation(a, b), F.lit(0.0))), F.lit(0.0)), F.lit(1.0))


def fuse(a, b, how: str = "concat") -> Column:
    """Image and text vectors as one; a missing text counts as zeros of the image's length."""
    a = _c(a)
    b = F.coalesce(_c(b), F.transform(a, lambda x: x * 0))
    return F.concat(a, b) if how == "concat" else F.zip_with(a, b, lambda x, y: (x + y) / 2)


def extrapolation_error(last, before, current) -> Column:
    """Cosine distance of ``current`` from the unit vector along 2 * last - before; 0 without both."""
    ahead = F.zip_with(_c(last), _c(before), lambda x, y: 2 * x.cast("double") - y.cast("double"))
    return F.coalesce(F.when(_c(before).isNotNull() & _c(last).isNotNull(), cosine_distance(ahead, current)), F.lit(0.0))


def _cosine_distances(x: list, y: list) -> np.ndarray:
    """Like ``cosine_distance``, for lists of arrays or None."""
    out = np.zeros(len(x))
    sizes = np.array([len(a) if a is not None and b is not None and len(a) == len(b) else 0 for a, b in zip(x, y)])
    for n in set(sizes.tolist()) - {0}:
        rows = np.flatnonzero(sizes == n)
        a, b = (np.stack([v[i] for i in rows]).astype(np.float64) for v in (x, y))
        la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        good = (la >= 1e-10) & (lb >= 1e-10)
        cosine = (a * b).sum(axis=1) / np.where(good, la * lb, 1.0)
        out[rows] = np.where(good, np.clip((1 - cosine) / 2, 0, 1), 0.0)
    return out


def step_distances(current, last, before=None) -> Column:
    """STRUCT<moved, surprise>: ``cosine_distance(current, last)``, and ``extrapolation_error(last, before, current)``,
    or without ``before`` ``extrapolation_error(current, last, current)``; in Arrow batches, where lambdas over
    the arrays would be interpreted number by number."""

    @F.pandas_udf("moved double, surprise double")
    def distances(now: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        return step_frame(now.to_list(), one.to_list(), two.to_list())

    @F.pandas_udf("moved double, surprise double")
    def of_two(now: pd.Series, one: pd.Series) -> pd.DataFrame:
        x, y = now.to_list(), one.to_list()
        return step_frame(x, y, y, x)

    return of_two(_c(current), _c(last)) if before is None else distances(_c(current), _c(last), _c(before))


def step_frame(now: list, one: list, two: list, newest: list | None = None) -> pd.DataFrame:
    ahead = [2 * a.astype(np.float64) - b if a is not None and b is not None and len(a) == len(b) else None for a, b in zip(newest or one, two)]
    return pd.DataFrame({"moved": _cosine_distances(now, one), "surprise": _cosine_distances(ahead, now)})


def digest(a, places: int = 6) -> Column:
    """A fingerprint of a whole vector to so many places."""
    return F.md5(F.array_join(F.transform(_c(a), lambda x: F.round(x.cast("double") * 10**places).cast("long").cast("string")), ","))
