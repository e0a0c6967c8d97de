"""Arithmetic on calendar grids.

A grid is fixed by the first timestamp of a series and a frequency. ``D``, ``H`` and ``T`` (minutes) step from
that timestamp itself; ``W`` falls on Sundays; ``M``, ``Q`` and ``Y`` on the last day of the period. The time of
day of the first timestamp is kept. All expressions work on TIMESTAMP_NTZ without a time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.spec import freq_code

_STEP_MICROS = {"D": 86_400_000_000, "H": 3_600_000_000, "T": 60_000_000, "MIN": 60_000_000}
_MONTHS = {"M": 1, "ME": 1, "Q": 3, "QE": 3, "Y": 12, "YE": 12, "A": 12}
FREQUENCIES = ("D", "W", "M", "Q", "Y", "H", "T")
_DAY = _STEP_MICROS["D"]


def check_freq(freq: str) -> str:
    code = freq_code(freq)
    if code not in _STEP_MICROS and code not in _MONTHS and code != "W":
        raise ValueError(f"unknown frequency {freq!r}; expected one of {', '.join(FREQUENCIES)}")
    return code


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 on the wall clock, whatever the session time zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
    # Time zone offsets are whole seconds, so the fraction of a second is the same in all of them.
    return seconds * 1_000_000 + F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))


def time_of_day(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(_DAY))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _period(ts: Column, months: int) -> Column:
    return F.floor((F.year(ts) * 12 + F.month(ts) - 1) / months)


def _ends_period(ts: Column, months: int) -> Column:
    return (F.last_day(ts) == F.to_date(ts)) & (F.month(ts) % months == 0)


def _div(a: Column, b: int) -> Column:
    """Whole-number quotient of a >= 0, exact for any long."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def _period_end(period: Column, months: int) -> Column:
    year = F.floor(period * months / 12).cast("int")
    return F.last_day(F.make_date(year, (period * months % 12 + months).cast("int"), F.lit(1)))


def _at(day: Column, tod: Column) -> Column:
    return F.timestamp_add("MICROSECOND", tod, day.cast("timestamp_ntz"))


def grid_anchor(first: Column, freq: str) -> Column:
    """What fixes the grid of a series that starts at ``first``: number of its first point, and time of day."""
    code = check_freq(freq)
    if code in _MONTHS:
        return F.struct(_period(first, _MONTHS[code]).alias("base"), time_of_day(first).alias("tod"))
    start = micros(first)
    if code == "W":
        start = start + (6 - F.weekday(first)).cast("long") * _DAY
    return F.struct(start.alias("base"), F.lit(0).cast("long").alias("tod"))


def anchored_point(k: Column, anchor: Column, freq: str) -> Column:
    """The k-th point (k >= 0) of the grid with that anchor."""
    code = check_freq(freq)
    if code in _MONTHS:
        return _at(_period_end(anchor["base"] + k, _MONTHS[code]), anchor["tod"])
    return from_micros(anchor["base"] + k.cast("long") * (7 * _DAY if code == "W" else _STEP_MICROS[code]))


def grid_point(k: Column, first: Column, freq: str) -> Column:
    """The k-th point (k >= 0) of the grid of a series that starts at ``first``."""
    return anchored_point(k, grid_anchor(first, freq), freq)


def grid_index(ts: Column, first: Column, freq: str) -> Column:
    """Position of ``ts`` on the grid; NULL if it does not lie on it."""
    code = check_freq(freq)
    if code in _STEP_MICROS:
        if code == "D":
            return F.when(time_of_day(ts) == time_of_day(first), F.datediff(ts, first).cast("long"))
        gap = micros(ts) - micros(first)
        return F.when(gap % F.lit(_STEP_MICROS[code]) == 0, _div(gap, _STEP_MICROS[code]))
    if code == "W":
        on_grid = (F.weekday(ts) == 6) & (time_of_day(ts) == time_of_day(first))
        return F.when(on_grid, F.floor((F.datediff(ts, first) - (6 - F.weekday(first))) / 7))
    months = _MONTHS[code]
    on_grid = _ends_period(ts, months) & (time_of_day(ts) == time_of_day(first))
    return F.when(on_grid, _period(ts, months) - _period(first, months))


def snapped_index(ts: Column, first: Column, freq: str) -> Column:
    """Position of the grid point that ``ts >= first`` is moved to: on a ``D``, ``H`` or ``T`` grid the nearest one (the later
    of two equally near), on the others the end of the week or period that it lies in. Of ``first`` itself it is 0."""
    code = check_freq(freq)
    if code in _STEP_MICROS:
        step = _STEP_MICROS[code]
        return _div(micros(ts) - micros(first) + step // 2, step)
    if code == "W":
        return F.floor((F.datediff(ts, first) + F.weekday(first)) / 7)
    return _period(ts, _MONTHS[code]) - _period(first, _MONTHS[code])


def last_index(first: Column, last: Column, freq: str) -> Column:
    """Index of the last grid point of a series that ends at ``last``; -1 if there is none.

    On a ``W`` or period-end grid a point after ``last`` is left out. If ``first`` lies on a grid day, so is the
    point of the last grid day whenever ``last`` has an earlier time of day than ``first``; that is how
    pandas' ``date_range`` ends such ranges.
    """
    code = check_freq(freq)
    if code in _STEP_MICROS:
        return _div(micros(last) - micros(first), _STEP_MICROS[code])
    if code == "W":
        k = F.floor((F.datediff(last, first) - (6 - F.weekday(first))) / 7)
        starts, ends = F.weekday(first) == 6, F.weekday(last) == 6
    else:
        months = _MONTHS[code]
        starts, ends = _ends_period(first, months), _ends_period(last, months)
        k = _period(last, months) - _period(first, months) - (~ends).cast("int")
    return k - ((time_of_day(first) > time_of_day(last)) & (starts | ends)).cast("int")


def step_ahead(last: Column, k: Column, freq: str) -> Column:
    """The timestamp ``k`` steps after ``last``. An off-grid ``last`` is rolled forward to the grid first."""
    return grid_point(k, last, freq)
