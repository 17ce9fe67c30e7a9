"""Owner metrics since the first entry, run rates since the cut-over, and the year's projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DateLike, in_dates, in_midnights, keys
from ..functions.dates import days_between
from ..operators.addbacks import detect_addbacks
from ..operators.classify import classify_transactions
from ..operators.metrics import (
    OWNER_MEASURES,
    PERIOD_MEASURES,
    monthly_rate,
    owner_sums,
    period_sums,
    projected,
    with_profit_lines,
)


def financial_analysis(
    ledger: DataFrame,
    today: DateLike,
    owner_revenue_start: DateLike,
    year_1_end: DateLike,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Owner metrics, ``monthly_*`` and ``proj_*`` in one pass; the period starts at the earliest
    date, which is the absence of a lower bound."""
    by = keys(by)
    flagged = detect_addbacks(classify_transactions(ledger))
    since_cut_over = in_midnights(flagged, "date", owner_revenue_start, today)
    sums = (
        flagged.where(in_dates(flagged, "date", None, today))
        .groupBy(*by)
        .agg(
            F.min(F.to_date("date")).alias("owner_period_start"),
            *owner_sums(flagged, owner_revenue_start),
            *period_sums(flagged, since_cut_over, "rr_"),
        )
    )
    both = with_profit_lines(with_profit_lines(sums), "rr_")
    elapsed, left = days_between(owner_revenue_start, today), days_between(today, year_1_end)
    rates = {c: monthly_rate(F.col(f"rr_{c}"), elapsed) for c in PERIOD_MEASURES}
    outlook = {
        c: projected(F.col(c), rates[c], left) if c in rates else F.col(c) for c in OWNER_MEASURES
    }
    outlook["gross_profit"] = outlook["revenue"] - outlook["cogs"]
    return both.select(
        *by,
        "owner_period_start",
        *OWNER_MEASURES,
        *[rates[c].alias(f"monthly_{c}") for c in PERIOD_MEASURES],
        *[outlook[c].alias(f"proj_{c}") for c in OWNER_MEASURES],
    )
