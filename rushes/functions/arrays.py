"""Array and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed in double."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """``v`` divided by its length; null for a zero vector."""
    length = F.nullif(norm(v), F.lit(0.0))
    return F.transform(_c(v), lambda x: x.cast("double") / length)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """``1 - cos(a, b)``; null when either vector has no length."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def linspace_pick(arr: Column | str, k: int) -> Column:
    """``k`` evenly spaced elements, first and last included; the whole array when it has at most ``k``."""
    a = _c(arr)
    n = F.size(a)
    if k == 1:
        spaced = F.slice(a, 1, 1)
    else:
        step = (n - 1).cast("double") / (k - 1)
        spaced = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.get(a, F.when(i == k - 1, n - 1).otherwise(F.floor(i * step).cast("int"))),
        )
    return F.when(n <= k, a).otherwise(spaced)


def step_pick(arr: Column | str, k: int) -> Column:
    """Elements at ``floor(i * n / k)``; the whole array when it has at most ``k``."""
    a = _c(arr)
    n = F.size(a)
    step = n.cast("double") / k
    stepped = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(a, F.floor(i * step).cast("int")))
    return F.when(n <= k, a).otherwise(stepped)


def slice_pick(arr: Column | str, mode: str) -> Column:
    """``ends``: first, middle, last when there are more than three; ``fourth``: every fourth element."""
    a = _c(arr)
    n = F.size(a)
    if mode == "ends":
        three = F.array(F.get(a, F.lit(0)), F.get(a, F.floor(n / 2).cast("int")), F.get(a, n - 1))
        return F.when(n <= 3, a).otherwise(three)
    if mode == "fourth":
        return F.filter(a, lambda x, i: i % 4 == 0)
    raise ValueError(f"unknown mode: {mode}")


def uniform_times(duration: Column | str, n: Column | int) -> Column:
    """``n`` timestamps that cut the duration into ``n + 1`` equal parts; empty for ``n < 1``."""
    count = F.lit(n) if isinstance(n, int) else n
    step = _c(duration) / (count + 1)
    times = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda j: step * j)
    return F.when(count < 1, F.array().cast("array<double>")).otherwise(times)
