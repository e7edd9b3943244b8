"""Rounding, clipping, guarded means and guarded correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def half_even(col: Column, places: int = 0) -> Column:
    """Round half to even the way array libraries do: scale, round to integer, unscale."""
    scale = float(10**places)
    return F.rint(col * scale) / scale


def clip_zero(col: Column) -> Column:
    """Lower bound of zero that leaves nulls null (``greatest`` would turn them into 0)."""
    return F.when(col < 0, F.lit(0.0)).otherwise(col)


def full_window_mean(col: Column, window: WindowSpec, size: int) -> Column:
    """Mean over the frame only when it holds ``size`` values; otherwise null."""
    return F.when(F.count(col).over(window) == size, F.avg(col).over(window))


def any_null(columns: list[str]) -> Column:
    """True where at least one of the named columns is null."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present.

    A side that is constant has no correlation, so the result is null rather than
    zero; the built-in ``corr`` raises on it under ANSI mode.
    """
    x_seen = F.when(y.isNotNull(), x.cast("double"))
    y_seen = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(x_seen, y_seen), F.stddev_pop(x_seen) * F.stddev_pop(y_seen))
