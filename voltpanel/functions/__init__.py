"""Column expressions: everything here stays inside JVM code generation."""

from voltpanel.functions.calendar import day_name, day_of_week, is_federal_holiday, is_weekend
from voltpanel.functions.numeric import any_null, clip_zero, full_window_mean, half_even, pearson
from voltpanel.functions.thermal import cooling_degrees, heating_degrees, hours_from_seconds, mean_temperature

__all__ = [
    "any_null",
    "clip_zero",
    "cooling_degrees",
    "day_name",
    "day_of_week",
    "full_window_mean",
    "half_even",
    "heating_degrees",
    "hours_from_seconds",
    "is_federal_holiday",
    "is_weekend",
    "mean_temperature",
    "pearson",
]
