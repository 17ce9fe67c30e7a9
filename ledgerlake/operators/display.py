"""Rendering of dates and redaction of text for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named
from ..functions.text import SENSITIVE_NAMES, redact

DAY, MOMENT = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def render_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Date and timestamp columns as text; with the time if any row of the column has one.

    Whether one has is a single one-row aggregate over all columns, used as a scalar subquery.
    """
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    dated = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, kinds) and (columns is None or f.name in columns)
    ]
    timed = [c for c in dated if not isinstance(df.schema[c].dataType, T.DateType)]
    shown = {c: F.date_format(named(c), DAY) for c in dated}
    if timed:
        has_clock = df.agg(
            F.struct(
                *[
                    F.coalesce(F.bool_or(_has_clock(named(c))), F.lit(False)).alias(f"c{i}")
                    for i, c in enumerate(timed)
                ]
            )
        ).scalar()
        for i, c in enumerate(timed):
            moment = F.date_format(named(c), MOMENT)
            shown[c] = F.when(has_clock.getField(f"c{i}"), moment).otherwise(shown[c])
    return df.withColumns(shown) if shown else df


def _has_clock(column: Column) -> Column:
    return F.hour(column) + F.minute(column) + F.second(column) > 0


def redact_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mask paths, private links and identifiers in text; drop columns with sensitive names."""
    kept = [c for c in df.columns if not any(word in c.lower() for word in SENSITIVE_NAMES)]
    texts = [
        f.name
        for f in df.schema
        if f.name in kept
        and isinstance(f.dataType, T.StringType)
        and (columns is None or f.name in columns)
    ]
    return df.select(*[redact(named(c)).alias(c) if c in texts else named(c) for c in kept])
