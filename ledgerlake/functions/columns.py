"""Small Column helpers shared by every operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DateLike = dt.date | str


def as_date(value: DateLike) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def keys(by: str | Sequence[str] | None) -> list[str]:
    """Normalise the ``by=`` argument that every aggregate takes."""
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# The characters that count as blank at either end of a text.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column) -> Column:
    """The text without blanks of any kind at its ends."""
    return F.btrim(column, F.lit(BLANKS))


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def text(df: DataFrame, name: str) -> Column:
    """A text column with nulls read as blank; blank when the column is absent."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def flag(df: DataFrame, name: str, default: bool = False) -> Column:
    """A boolean column with nulls read as false."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def money(df: DataFrame, name: str = "amount") -> Column:
    """The amount to sum: a decimal as it is, anything else as a double without NaNs.

    Doubles give what double arithmetic gives. Decimals are summed exactly, in whatever order
    the rows come, and turned into a double at the end.
    """
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return F.col(name)
    return as_double(name)


def as_double(name: str = "amount") -> Column:
    """A double whose NaNs count as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def total(amount: Column, where: Column | None = None) -> Column:
    """Sum of ``amount`` over the rows where the condition holds; 0.0 when there are none."""
    picked = amount if where is None else F.when(where, amount)
    return F.coalesce(F.sum(picked), F.lit(0.0))


def magnitude(amount: Column) -> Column:
    """Signed total to positive size: both ledger sign conventions give the same figure."""
    return F.coalesce(F.abs(amount), F.lit(0.0))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Null instead of an error or infinity when the denominator is zero."""
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0.0)))


def round_half_even(amount: Column, digits: int = 2) -> Column:
    """Scale, round half to even, unscale, all in floating point."""
    scale = float(10**digits)
    return F.rint(amount * F.lit(scale)) / F.lit(scale)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often ``body`` uses it.

    A plain helper column gives no such promise: the optimizer may write its definition into
    every place of use, also into the inner loop of a higher-order function.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def _instant(df: DataFrame, name: str, day: dt.date) -> Column:
    """Midnight of ``day`` in the column's own type, so that the comparison reaches the scan."""
    dtype = df.schema[name].dataType
    if not isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"column {name!r} is {dtype.simpleString()}, expected a date or timestamp")
    return F.lit(day.isoformat()).cast(dtype)


def on_or_after(df: DataFrame, name: str, day: DateLike) -> Column:
    return F.col(name) >= _instant(df, name, as_date(day))


def before(df: DataFrame, name: str, day: DateLike) -> Column:
    return F.col(name) < _instant(df, name, as_date(day))


def in_dates(df: DataFrame, name: str, start: DateLike | None, end: DateLike | None) -> Column:
    """Whole-day window, both ends included, as a half-open range that parquet can prune on."""
    inside = F.col(name).isNotNull()
    if start is not None:
        inside = inside & on_or_after(df, name, start)
    if end is not None:
        inside = inside & before(df, name, as_date(end) + dt.timedelta(days=1))
    return inside


def in_midnights(df: DataFrame, name: str, start: DateLike, end: DateLike) -> Column:
    """Window compared with midnight: a time of day on the last date falls outside."""
    return on_or_after(df, name, start) & (F.col(name) <= _instant(df, name, as_date(end)))


def membership(column: Column, values: Iterable[str] | None) -> Column:
    wanted = sorted(set(values or ()))
    return F.coalesce(column.isin(wanted), F.lit(False)) if wanted else F.lit(False)
