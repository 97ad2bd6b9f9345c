"""Sunday weeks, scenario calendars and period labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as stored in fiscal_month.
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST",
          "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]


WEEKS_A_YEAR = 52


def floor_week_sunday(date: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(date, F.dayofweek(date) - 1)


def week_sequence(start: Column, end: Column) -> Column:
    """All Sundays from the week of ``start`` to the week of ``end``, as an array."""
    return F.sequence(floor_week_sunday(start), floor_week_sunday(end),
                      F.expr("interval 7 days"))


def same_weeks_last_year(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last week of the stretch one year earlier, with as many weeks."""
    first = floor_week_sunday(F.add_months(start, -12))
    days = F.datediff(floor_week_sunday(end), floor_week_sunday(start))
    return first, F.date_add(first, days)


def as_date(day: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def sunday_of(day: str | dt.date) -> dt.date:
    """``floor_week_sunday`` for a date known to the driver."""
    day = as_date(day)
    return day - dt.timedelta(days=(day.weekday() + 1) % 7)


def last_year_bounds(start: str | dt.date, end: str | dt.date) -> tuple[dt.date, dt.date]:
    """``same_weeks_last_year`` for dates known to the driver."""
    day = as_date(start)
    if (day.month, day.day) == (2, 29):
        day = day.replace(day=28)
    first = sunday_of(day.replace(year=day.year - 1))
    return first, first + (sunday_of(end) - sunday_of(start))


def week_after_a_year(week: Column) -> Column:
    """The Sunday 52 weeks on: the day before the Monday week holding week + 365 days."""
    monday = F.to_date(F.date_trunc("week", F.date_add(week, 365)))
    return F.date_sub(monday, 1)


def week_a_year_back(week: Column) -> Column:
    """The Sunday 52 weeks before; ``week_after_a_year`` leads back."""
    return F.date_sub(floor_week_sunday(week), 7 * WEEKS_A_YEAR)


def week_correspondence(start: Column, end: Column) -> Column:
    """All weeks from that of ``start`` to that of ``end``, each with its week a year back.

    An array of structs pos (from 0), week, old_week.  Scenarios take every week of last year
    from here, so that a row and its comparison are always of the same two weeks.
    """
    return F.transform(week_sequence(start, end), lambda w, i: F.struct(
        i.alias("pos"), w.alias("week"), F.date_sub(w, 7 * WEEKS_A_YEAR).alias("old_week")))


def old_week_bounds(start: str | dt.date, end: str | dt.date) -> tuple[dt.date, dt.date]:
    """First and last ``old_week`` of the correspondence, for dates known to the driver."""
    year = dt.timedelta(days=7 * WEEKS_A_YEAR)
    return sunday_of(start) - year, sunday_of(end) - year


def year_of(week: Column) -> Column:
    return F.year(week)


def month_code(month_name: Column) -> Column:
    """JANUARY -> 01 ... DECEMBER -> 12, null for anything else."""
    pairs = [F.lit(v) for i, name in enumerate(MONTHS) for v in (name, f"{i + 1:02d}")]
    return F.try_element_at(F.create_map(*pairs), month_name)


def period_label(*parts: Column) -> Column:
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def driver_key(h2: Column, h1: Column, driver: Column) -> Column:
    return F.concat_ws("-:-", h2, h1, driver)
