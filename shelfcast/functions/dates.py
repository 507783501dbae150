"""Calendar features. All of them are known in advance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations as programme schedules spell them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def iso_weekday(date: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(date) + 1


def month_abbreviation(date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(date))


def calendar_columns(date: Column) -> dict[str, Column]:
    left = F.datediff(F.last_day(date), date)
    return {
        "day": F.dayofmonth(date),
        "month": F.month(date),
        "year": F.year(date),
        "week_of_year": F.weekofyear(date),
        "day_of_year": F.dayofyear(date),
        "days_to_month_end": left,
        "is_month_start": (F.dayofmonth(date) <= 5).cast("int"),
        "is_month_end": (left <= 5).cast("int"),
    }


def monday_of_week(year: Column, week: Column) -> Column:
    """Monday of week ``week``, weeks counted from the year's first Monday.

    Outside 1..53 there is no such week and the result is NULL.
    """
    new_years_eve = F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 1)
    monday = F.date_add(F.next_day(new_years_eve, "MON"), (7 * (week - 1)).cast("int"))
    return F.when(week.between(1, 53), monday)


def month_start(year: Column, month: Column) -> Column:
    safe = F.when(month.between(1, 12), month)
    return F.make_date(year, safe, F.lit(1))
