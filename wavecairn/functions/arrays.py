"""Row-local array expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Non-finite samples become NULL."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression inside a lambda is evaluated again for every element, so everything that does
    not depend on the element is bound first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values))


def _spread(values: Column, mean: Column) -> Column:
    return F.sqrt(F.try_divide(array_sum(values, lambda x: (x - mean) * (x - mean)), F.size(values)))


def array_std(values: Column) -> Column:
    """Population standard deviation of an array column."""
    return let(array_mean(values), lambda mean: _spread(values, mean))


def sorted_median(ordered: Column) -> Column:
    """Median of a sorted array column without nulls; NULL when it is empty."""
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (low + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def array_median(values: Column) -> Column:
    """Median of the non-null elements."""
    return let(F.sort_array(F.array_compact(values)), sorted_median)


def fill_with_median(values: Column) -> Column:
    return let(
        F.coalesce(array_median(values), F.lit(0.0)), lambda m: F.transform(values, lambda x: F.coalesce(x, m))
    )


def robust_normalise(values: Column, eps: float = 1e-12) -> Column:
    """(x - median) / scale; scale is 1.4826 MAD, else the population deviation, else 1."""

    def scaled(median: Column) -> Column:
        mad = F.lit(1.4826) * array_median(F.transform(values, lambda x: F.abs(x - median)))
        stats = F.struct(mad.alias("mad"), array_std(values).alias("std"))
        scale = let(stats, lambda t: F.when(t["mad"] > eps, t["mad"]).when(t["std"] > eps, t["std"]).otherwise(1.0))
        return let(scale, lambda k: F.transform(values, lambda x: (x - median) / k))

    return let(array_median(values), scaled)


def resample_linear(values: Column, points: int) -> Column:
    """Linear interpolation of an array column onto ``points`` equally spaced positions."""

    def at(k: Column) -> Column:
        last = F.size(values) - 1

        def between(position: Column) -> Column:
            left = F.least(F.floor(position), last).cast("int")
            share = position - left
            return F.get(values, left) * (1 - share) + F.get(values, F.least(left + 1, last)) * share

        return let(k * last / F.lit(float(points - 1)), between)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest elements of a short array."""
    return let(F.slice(F.sort_array(values, asc=False), 1, k), array_mean)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))
