"""Monthly profit table and addbacks by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    DateLike,
    as_date,
    before,
    flag,
    keys,
    magnitude,
    money,
    safe_divide,
    total,
)
from ..functions.dates import month_label, month_start

# Class labels summed into each line; both spellings of the last are in use.
CLASS_LABELS = {
    "revenue": ("Revenue",),
    "cogs": ("COGS",),
    "overhead": ("Overhead",),
    "other_expense": ("Other", "Other Expense"),
}

# The measures' names and their order.
MONTHLY_COLUMNS = (
    "month", "month_str", "revenue", "cogs", "overhead", "other_expense", "gross_profit",
    "net_profit", "addbacks", "sde", "gross_margin_pct", "net_margin_pct", "sde_margin_pct",
    "overhead_pct", "cogs_pct", "revenue_mom_delta", "revenue_mom_pct", "net_profit_mom_delta",
    "net_profit_mom_pct", "sde_mom_delta", "sde_mom_pct",
)


def compute_monthly_kpis(
    df: DataFrame, owner_revenue_start: DateLike, by: str | Sequence[str] = ()
) -> DataFrame:
    """Monthly lines, margins and change against the previous month present.

    Revenue before the cut-over counts as zero. Addbacks are sums of absolute amounts here. The
    change columns are taken after the aggregation, over one row per key and month.
    """
    by = keys(by)
    for needed in ("date", "amount"):
        if needed not in df.columns:
            raise ValueError(f"compute_monthly_kpis requires a '{needed}' column")
    label = F.col("classification") if "classification" in df.columns else F.lit("Other")
    counted = F.when(
        flag(df, "is_revenue") & before(df, "date", owner_revenue_start), F.lit(0)
    ).otherwise(money(df))
    lines = [
        magnitude(total(counted, label.isin(*labels))).alias(name)
        for name, labels in CLASS_LABELS.items()
    ]
    addbacks = total(F.abs(money(df)), flag(df, "sde_addback_flag")).alias("addbacks")

    months = (
        df.where(F.col("date").isNotNull())
        .groupBy(*by, month_start(F.col("date")).alias("month"))
        .agg(*lines, addbacks)
        .withColumn("gross_profit", F.col("revenue") - F.col("cogs"))
        .withColumn("net_profit", F.col("gross_profit") - F.col("overhead") - F.col("other_expense"))
        .withColumn("sde", F.col("net_profit") + F.col("addbacks"))
    )
    shares = {
        "gross_margin_pct": "gross_profit",
        "net_margin_pct": "net_profit",
        "sde_margin_pct": "sde",
        "overhead_pct": "overhead",
        "cogs_pct": "cogs",
    }
    in_order = Window.partitionBy(*by).orderBy("month")
    change = {}
    for measure in ("revenue", "net_profit", "sde"):
        previous = F.lag(measure).over(in_order)
        change[f"{measure}_mom_delta"] = F.col(measure) - previous
        change[f"{measure}_mom_pct"] = safe_divide(F.col(measure) - previous, previous)
    return (
        months.withColumns({n: safe_divide(F.col(c), F.col("revenue")) for n, c in shares.items()})
        .withColumns({"month_str": month_label(F.col("month")), **change})
        .select(*by, *MONTHLY_COLUMNS)
        .orderBy(*by, "month")
    )


def addbacks_by_month(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Size and number of the flagged rows of each month."""
    by = keys(by)
    return (
        df.where(flag(df, "sde_addback_flag") & F.col("date").isNotNull())
        .groupBy(*by, month_start(F.col("date")).alias("month"))
        .agg(total(F.abs(money(df))).alias("addbacks"), F.count(F.lit(1)).alias("count"))
        .withColumn("month_str", month_label(F.col("month")))
        .select(*by, "month", "month_str", "addbacks", "count")
        .orderBy(*by, "month")
    )


def months_from(monthly: DataFrame, start: DateLike) -> DataFrame:
    """Months on or after the one that ``start`` falls in."""
    return monthly.where(F.col("month") >= F.lit(as_date(start).replace(day=1)))


def chart_series(monthly: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return monthly.select(*keys(by), "month_str", "revenue", "net_profit", "sde")


def margin_view(monthly: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return monthly.select(
        *keys(by),
        "month_str",
        F.col("net_margin_pct").alias("Net Margin %"),
        F.col("sde_margin_pct").alias("SDE Margin %"),
    )


def monthly_summary(monthly: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return monthly.select(
        *keys(by),
        F.col("month_str").alias("Month"),
        "revenue",
        "cogs",
        "overhead",
        "other_expense",
        "net_profit",
        "addbacks",
        "sde",
    )
