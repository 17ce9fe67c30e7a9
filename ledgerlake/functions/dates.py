"""Date text to timestamps, month buckets and day counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import DateLike, as_date, bind, strip

# Spellings whose time of day is dropped, and their formats.
WHOLE_DAY_PATTERN = (
    r"(?U)^(?:(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})(?:$|\s)"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:$|\s|T))"
)
WHOLE_DAY_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "yyyy/M/d")

# Further spellings, which keep a time of day.
LENIENT_FORMATS = (
    "M/d/yyyy",
    "M-d-yyyy",
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy.M.d",
    "yyyyMMdd",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "M.d.yyyy",
    "MMM yyyy",
    "MMMM yyyy",
    "yyyy-MM",
)

# A weekday before a date, which says nothing more.
WEEKDAY_PATTERN = r"(?i)^(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\.?,?\s+(?=[0-9a-z])"

# Day-first spellings, only reached where month-first is impossible.
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy")

# Two-digit years, written out before parsing; they lie between 1975 and 2074.
SHORT_YEARS = (
    (r"^([0-9]{1,2}[/-][0-9A-Za-z]{1,3}[/-])(7[5-9]|[89][0-9])$", "$119$2"),
    (r"^([0-9]{1,2}[/-][0-9A-Za-z]{1,3}[/-])([0-6][0-9]|7[0-4])$", "$120$2"),
    (r"^([0-9]{1,2} [A-Za-z]{3,9} )(7[5-9]|[89][0-9])$", "$119$2"),
    (r"^([0-9]{1,2} [A-Za-z]{3,9} )([0-6][0-9]|7[0-4])$", "$120$2"),
)

CLOCK_PATTERN = (
    r"(?U)[\sT]+([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?(?:\.[0-9]+)?\s*([AaPp][Mm])?$"
)
# Fixed value: a full hour, written out before parsing.
FULL_HOUR = (r"(?i)(\s(?:1[0-2]|0?[1-9]))\s*([ap]m)$", "$1:00 $2")


def _parse(text: Column, formats: tuple[str, ...]) -> Column:
    """Date by whichever format fits, tried in one go. The text must not be blank."""
    return F.try_to_date(text, "".join(f"[{fmt}]" for fmt in formats))


def _time_of_day(value: Column) -> Column:
    """Clock time at the end of the text as an interval."""

    def part(group: int) -> Column:
        return F.regexp_extract(value, CLOCK_PATTERN, group)

    def number(group: int) -> Column:
        return F.coalesce(part(group).try_cast("int"), F.lit(0))

    hour = (
        F.when(part(4) == "", number(1))
        .when(F.lower(part(4)) == "pm", number(1) % 12 + 12)
        .otherwise(number(1) % 12)
    )
    return F.make_dt_interval(F.lit(0), hour, number(2), number(3).cast("decimal(18,6)"))


def parse_date(column: Column) -> Column:
    """Mixed-format date text to ``TIMESTAMP_NTZ``; null when no listed spelling fits.

    The steps are bound as array elements: each is worked out once, and the generated code stays
    small enough to be compiled where the result is both filtered on and projected.
    """

    def parsed(value: Column) -> Column:
        whole_day = F.when(
            value.rlike(WHOLE_DAY_PATTERN),
            _parse(F.regexp_replace(value, r"(?U)[\sT].*$", ""), WHOLE_DAY_FORMATS),
        )
        day = F.regexp_replace(value, CLOCK_PATTERN, "")
        for pattern, year in SHORT_YEARS:
            day = F.regexp_replace(day, pattern, year)
        clock = F.when(value.contains(":"), _time_of_day(value)).otherwise(
            F.expr("INTERVAL '0 00:00:00' DAY TO SECOND")
        )
        return F.coalesce(
            whole_day.cast("timestamp_ntz"), bind(day, _lenient).cast("timestamp_ntz") + clock
        )

    plain = F.regexp_replace(strip(column.cast("string")), WEEKDAY_PATTERN, "")
    return bind(F.regexp_replace(plain, *FULL_HOUR), parsed)


def _lenient(day: Column) -> Column:
    return F.when(
        day.rlike("[0-9]"), F.coalesce(_parse(day, LENIENT_FORMATS), _parse(day, DAY_FIRST_FORMATS))
    )



def month_start(column: Column) -> Column:
    return F.trunc(F.to_date(column), "month")


def month_label(month: Column) -> Column:
    return F.date_format(month, "MMM yyyy")


def prior_month(day: DateLike) -> tuple[dt.date, dt.date]:
    """First and last day of the calendar month before the one ``day`` falls in."""
    last = as_date(day).replace(day=1) - dt.timedelta(days=1)
    return last.replace(day=1), last


def prior_month_start(column: Column) -> Column:
    return F.add_months(month_start(column), -1)


def prior_month_end(column: Column) -> Column:
    return F.last_day(prior_month_start(column))


def days_between(start: DateLike, end: DateLike) -> int:
    """Elapsed days; the end date itself is not counted."""
    return (as_date(end) - as_date(start)).days


