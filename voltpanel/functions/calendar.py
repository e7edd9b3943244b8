"""Calendar expressions.  Weekdays count from Monday = 0."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# US federal holidays as month * 100 + day, and as month, which weekday of
# the month, and the weekday.  Memorial Day is the last Monday of May.
FIXED_HOLIDAYS = [101, 704, 1111, 1225]
JUNETEENTH, JUNETEENTH_FROM = 619, 2021
FLOATING_HOLIDAYS = [(1, 3, 0), (2, 3, 0), (9, 1, 0), (10, 2, 0), (11, 4, 3)]
MEMORIAL_MONTH, MEMORIAL_FROM = 5, 25
# Month and first year of the Monday holidays that were introduced later.
FIRST_YEARS = {1: 1986, 2: 1971, 5: 1971, 10: 1971}


def day_of_week(day: Column) -> Column:
    return F.weekday(day)


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def _on_fixed_date(day: Column) -> Column:
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    return month_day.isin(FIXED_HOLIDAYS) | ((month_day == JUNETEENTH) & (F.year(day) >= JUNETEENTH_FROM))


def is_federal_holiday(day: Column) -> Column:
    """1 on a US federal holiday or on the weekday it is observed.

    A fixed-date holiday on Saturday is observed on the Friday before it (which may be
    31 December), one on Sunday on the Monday after.  A Monday holiday counts from its
    first year on.  Being a predicate on the date itself, it needs no holiday table and
    no join.
    """
    month, of_month, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    occurrence = F.ceil(of_month / 7)
    floating = (month * 100 + occurrence * 10 + weekday).isin([m * 100 + n * 10 + wd for m, n, wd in FLOATING_HOLIDAYS])
    memorial = (month == MEMORIAL_MONTH) & (of_month >= MEMORIAL_FROM) & (weekday == 0)
    observed = ((weekday == 4) & _on_fixed_date(F.date_add(day, 1))) | (
        (weekday == 0) & _on_fixed_date(F.date_sub(day, 1))
    )
    too_early = reduce(or_, [(month == m) & (F.year(day) < first) for m, first in FIRST_YEARS.items()])
    return (_on_fixed_date(day) | ((floating | memorial) & ~too_early) | observed).cast("int")
