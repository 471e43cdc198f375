"""Row-local array maths: one pattern per row, no explode and no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and evaluate ``body`` on the binding."""
    return F.element_at(F.transform(F.array(value), body), 1)


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def array_mean(values: Column) -> Column:
    return let(present(values), lambda v: F.try_divide(array_sum(v), F.size(v).cast("double")))


def array_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of the non-null entries."""
    def at(s: Column) -> Column:
        rank = F.lit(float(q)) * (F.size(s) - 1)
        low = F.floor(rank).cast("int")
        low_value = F.get(s, low)
        high_value = F.get(s, F.ceil(rank).cast("int"))
        return low_value + (high_value - low_value) * (rank - low)
    return let(F.sort_array(present(values)), lambda s: F.when(F.size(s) > 0, at(s)))


def array_median(values: Column) -> Column:
    return array_quantile(values, 0.5)


def array_mad_sigma(values: Column) -> Column:
    """1.4826 x median absolute deviation; 0 for an empty row."""
    mad = let(array_median(values),
              lambda m: array_median(F.transform(values, lambda x: F.abs(x - m))))
    return F.coalesce(F.lit(MAD_TO_SIGMA) * mad, F.lit(0.0))


def array_diff(values: Column) -> Column:
    """First differences; null where either neighbour is null."""
    return F.when(F.size(values) > 1,
                  F.zip_with(F.slice(values, F.lit(2), F.size(values) - 1),
                             F.slice(values, F.lit(1), F.size(values) - 1),
                             lambda right, left: right - left))


def array_std(values: Column) -> Column:
    """Population standard deviation of the non-null entries."""
    return let(array_mean(values), lambda m: F.sqrt(
        array_mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def array_dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda a, b: a * b))


def array_norm(values: Column) -> Column:
    return F.sqrt(array_dot(values, values))


def pearson(left: Column, right: Column) -> Column:
    """Pearson correlation of two equal-length rows.

    Null when a value is missing or either row is constant to machine precision.
    """
    def centred(v: Column) -> Column:
        return let(array_mean(v), lambda m: F.transform(v, lambda x: x - m))

    def score(pair: Column) -> Column:
        norm = array_norm(pair["a"]) * array_norm(pair["b"])
        return F.when(norm > 2.220446049250313e-16,
                      F.greatest(F.lit(-1.0), F.least(F.lit(1.0),
                                                      array_dot(pair["a"], pair["b"]) / norm)))
    complete = ~F.exists(left, lambda x: x.isNull()) & ~F.exists(right, lambda x: x.isNull())
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 1) & complete,
                  let(F.struct(centred(left).alias("a"), centred(right).alias("b")), score))


def cosine(left: Column, right: Column) -> Column:
    norm = array_norm(left) * array_norm(right)
    return F.when(norm > 0, array_dot(left, right) / norm).otherwise(F.lit(0.0))


def to_double_array(values: Column) -> Column:
    """Ingest an array column: cast to double and turn NaN into null."""
    return F.transform(values, lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double")))
