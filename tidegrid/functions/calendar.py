"""Calendar features and the Russian public-holiday calendar."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days off of the Russian Federation that fall on the same date each year, by the years in which they
# were days off: (month, day, first year, last year), None without a bound.
RUSSIAN_HOLIDAYS = (
    (1, 1, None, None), (1, 2, None, None), (1, 3, 2005, None), (1, 4, 2005, None), (1, 5, 2005, None), (1, 6, 2013, None),
    (1, 7, None, None), (1, 8, 2013, None), (2, 23, 2002, None), (3, 8, None, None), (5, 1, None, None), (5, 2, None, 2004),
    (5, 9, None, None), (6, 12, None, None), (11, 4, 2005, None), (11, 7, None, 2004), (12, 12, 1994, 2004),
)


def _cycle(f: Callable[[Column], Column], part: Callable[[Column], Column], period: int) -> Callable[[Column], Column]:
    return lambda ts: f(F.lit(2 * math.pi) * part(ts) / F.lit(period))


def _flag(condition: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda ts: condition(ts).cast("int")


TIME_FEATURES: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "day": F.day,
    "dayofweek": F.weekday,  # Monday is 0
    "quarter": F.quarter,
    "hour": F.hour,
    "minute": F.minute,
    "is_weekend": _flag(lambda ts: F.weekday(ts) >= 5),
    "is_month_start": _flag(lambda ts: F.day(ts) == 1),
    "is_month_end": _flag(lambda ts: F.to_date(ts) == F.last_day(ts)),
    "sin_month": _cycle(F.sin, F.month, 12),
    "cos_month": _cycle(F.cos, F.month, 12),
    "sin_day": _cycle(F.sin, F.day, 31),
    "cos_day": _cycle(F.cos, F.day, 31),
    "sin_dayofweek": _cycle(F.sin, F.weekday, 7),
    "cos_dayofweek": _cycle(F.cos, F.weekday, 7),
}

DEFAULT_TIME_FEATURES = (
    "year", "month", "day", "dayofweek", "quarter", "is_weekend", "is_month_start", "is_month_end",
    "sin_month", "cos_month",
)


def is_fixed_holiday(ts: Column) -> Column:
    """True on a fixed holiday of its year. Needs no join: a comparison per range of years."""
    spans: dict[tuple[int | None, int | None], list[int]] = {}
    for month, day, first, last in RUSSIAN_HOLIDAYS:
        spans.setdefault((first, last), []).append(month * 100 + day)
    found = F.lit(False)
    for (first, last), days in spans.items():
        one = (F.month(ts) * 100 + F.day(ts)).isin(days)
        if first:
            one &= F.year(ts) >= first
        if last:
            one &= F.year(ts) <= last
        found |= one
    return found
