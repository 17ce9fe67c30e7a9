"""KPI actuals from a transaction detail, for the owner period and the run-rate period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DateLike, as_date, in_dates, keys
from ..functions.dates import days_between
from ..operators.addbacks import detect_addbacks
from ..operators.classify import classify_transactions
from ..operators.metrics import KPI_MEASURES, kpi_sums, with_profit_lines

PERIODS = ("owner_period", "run_rate_period")


def _both_periods(
    detail: DataFrame,
    current_date: DateLike,
    owner_period_start: DateLike,
    owner_revenue_start: DateLike,
    by: Sequence[str],
) -> DataFrame:
    """Measures of both periods side by side: one scan, one classification, one aggregation."""
    first = min(as_date(owner_period_start), as_date(owner_revenue_start))
    flagged = detect_addbacks(
        classify_transactions(detail.where(in_dates(detail, "date", first, current_date)))
    )
    starts = dict(zip(PERIODS, (owner_period_start, owner_revenue_start)))
    sums = flagged.groupBy(*by).agg(
        *[
            column
            for period, start in starts.items()
            for column in kpi_sums(flagged, start, current_date, owner_revenue_start, f"{period}_")
        ]
    )
    for period in PERIODS:
        sums = with_profit_lines(sums, f"{period}_")
    return sums


def _measures(period: str) -> list[Column]:
    return [F.col(f"{period}_{c}").alias(c) for c in KPI_MEASURES]


def kpi_periods(
    detail: DataFrame,
    current_date: DateLike,
    owner_period_start: DateLike = "2025-07-01",
    owner_revenue_start: DateLike = "2025-08-01",
    by: str | Sequence[str] = (),
) -> DataFrame:
    """One row per period (and key)."""
    by = keys(by)
    both = _both_periods(detail, current_date, owner_period_start, owner_revenue_start, by)
    rows = [F.struct(F.lit(period).alias("period"), *_measures(period)) for period in PERIODS]
    return both.select(*by, F.inline(F.array(*rows)))


def kpi_report(
    detail: DataFrame,
    current_date: DateLike,
    owner_period_start: DateLike = "2025-07-01",
    owner_revenue_start: DateLike = "2025-08-01",
    source_file: str = "",
    by: str | Sequence[str] = (),
) -> DataFrame:
    """The report record: metadata, both periods, summary."""
    by = keys(by)
    both = _both_periods(detail, current_date, owner_period_start, owner_revenue_start, by)
    metadata = F.struct(
        F.lit(source_file).alias("source_file"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("computed_at"),
        F.lit(str(as_date(current_date))).alias("current_date"),
        F.lit(str(as_date(owner_period_start))).alias("owner_period_start"),
        F.lit(str(as_date(owner_revenue_start))).alias("owner_revenue_start"),
    )
    summary = F.struct(
        F.lit(days_between(owner_period_start, current_date)).alias("owner_period_days"),
        F.lit(days_between(owner_revenue_start, current_date)).alias("run_rate_period_days"),
        F.col("owner_period_legacy_cogs").alias("july_legacy_cogs_excluded"),
        F.lit(True).alias("july_overhead_included"),
    )
    return both.select(
        *by,
        metadata.alias("metadata"),
        *[F.struct(*_measures(period)).alias(period) for period in PERIODS],
        summary.alias("summary"),
    )
