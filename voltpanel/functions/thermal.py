"""Temperature expressions.  Degrees are Fahrenheit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltpanel.functions.numeric import clip_zero, half_even

# The fitted balance points of the demand/temperature curve.
HEATING_BASE, COOLING_BASE = 50.0, 65.0


def mean_temperature(tmin: Column, tmax: Column) -> Column:
    return (tmin + tmax) / 2


def heating_degrees(tavg: Column, base: float = HEATING_BASE) -> Column:
    return clip_zero(F.lit(base) - tavg)


def cooling_degrees(tavg: Column, base: float = COOLING_BASE) -> Column:
    return clip_zero(tavg - F.lit(base))


def hours_from_seconds(seconds: Column) -> Column:
    return half_even(seconds / 3600.0, 2)
