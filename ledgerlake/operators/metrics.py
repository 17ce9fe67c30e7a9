"""Period profit metrics, legacy add-ins, run rates and projections.

Every figure is a conditional sum, so one pass and one small shuffle of partial sums (a row per
``by`` key and task) produce all measures of all periods asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accounts import JOB_COST_PREFIXES, account_code_prefix
from ..functions.columns import (
    DateLike,
    before,
    flag,
    in_dates,
    keys,
    magnitude,
    membership,
    money,
    on_or_after,
    text,
    total,
)
from ..functions.dates import prior_month
from .addbacks import detect_addbacks
from .classify import classify_transactions

DAYS_PER_MONTH = 30.4375

# The measures' names and their order.
PERIOD_MEASURES = (
    "revenue", "cogs", "overhead", "other_expense", "gross_profit", "net_profit", "addbacks", "sde",
)

# The measures' names and their order.
OWNER_MEASURES = (
    "revenue", "cogs", "legacy_cogs", "overhead", "other_expense", "gross_profit", "net_profit",
    "addbacks", "sde", "legacy_july_total_expense", "legacy_july_excluded_job_cost",
    "legacy_july_included_overhead",
)

# The measures' names and their order.
KPI_MEASURES = (
    "revenue", "cogs", "legacy_cogs", "overhead", "other_expense", "addbacks", "net_profit", "sde",
    "gross_profit",
)


def addback_total(amount: Column, flagged: Column) -> Column:
    """Positive size of the flagged rows: the positive ones if there are any, else the negative."""
    return F.coalesce(
        F.sum(F.when(flagged & (amount > 0), amount)),
        -F.sum(F.when(flagged & (amount < 0), amount)),
        F.lit(0.0),
    )


def profit_lines(m: Mapping[str, Column]) -> dict[str, Column]:
    """Gross profit, net profit and discretionary earnings from the summed measures."""
    net = m["revenue"] - (m["cogs"] + m["overhead"] + m["other_expense"])
    return {"gross_profit": m["revenue"] - m["cogs"], "net_profit": net, "sde": net + m["addbacks"]}


def with_profit_lines(sums: DataFrame, prefix: str = "") -> DataFrame:
    lines = profit_lines(
        {c: F.col(prefix + c) for c in ("revenue", "cogs", "overhead", "other_expense", "addbacks")}
    )
    return sums.withColumns({prefix + name: column for name, column in lines.items()})


def _alias(sums: Mapping[str, Column], prefix: str) -> list[Column]:
    return [column.alias(prefix + name) for name, column in sums.items()]


def period_sums(df: DataFrame, where: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates for the plain period metrics over the rows where the condition holds."""
    amount = money(df)
    inside = F.lit(True) if where is None else where
    sums = {
        name: magnitude(total(amount, inside & flag(df, f"is_{name}")))
        for name in ("revenue", "cogs", "overhead", "other_expense")
    }
    sums["addbacks"] = addback_total(amount, inside & flag(df, "sde_addback_flag"))
    return _alias(sums, prefix)


def owner_sums(
    df: DataFrame,
    owner_revenue_start: DateLike,
    addback_account_overrides: Iterable[str] | None = None,
    exclude_legacy_july_job_costs: bool = True,
    legacy_job_cost_prefixes: Iterable[str] | None = None,
    where: Column | None = None,
    prefix: str = "",
) -> list[Column]:
    """Aggregates for the owner metrics: rows before the cut-over count apart, as legacy."""
    amount = money(df)
    inside = F.lit(True) if where is None else where
    after = inside & on_or_after(df, "date", owner_revenue_start)
    earlier = inside & before(df, "date", owner_revenue_start)
    revenue, cogs, overhead, other = (
        flag(df, f"is_{name}") for name in ("revenue", "cogs", "overhead", "other_expense")
    )
    job = membership(
        account_code_prefix(text(df, "account")),
        JOB_COST_PREFIXES if legacy_job_cost_prefixes is None else legacy_job_cost_prefixes,
    )
    spent = overhead | other | cogs
    addback = flag(df, "sde_addback_flag") | membership(text(df, "account"), addback_account_overrides)
    kept_overhead = overhead & ~job if exclude_legacy_july_job_costs else overhead

    def size(condition: Column) -> Column:
        return magnitude(total(amount, condition))

    return _alias(
        {
            "revenue": size(after & revenue),
            "cogs": size(after & cogs),
            "legacy_cogs": size(earlier & cogs),
            "overhead": size(after & overhead),
            "other_expense": size(after & other),
            "addbacks": addback_total(amount, inside & addback),
            "legacy_july_total_expense": size(earlier & spent),
            "legacy_july_excluded_job_cost": size(earlier & spent & job),
            "legacy_july_included_overhead": size(earlier & kept_overhead),
        },
        prefix,
    )


def kpi_sums(
    df: DataFrame, start: DateLike, end: DateLike, revenue_start: DateLike, prefix: str = ""
) -> list[Column]:
    """Aggregates for one reporting period: overhead counts in full, revenue and job costs only
    from ``revenue_start`` on."""
    amount = money(df)
    inside = in_dates(df, "date", start, end)
    after = inside & on_or_after(df, "date", revenue_start)
    earlier = inside & before(df, "date", revenue_start)
    return _alias(
        {
            "revenue": magnitude(total(amount, after & flag(df, "is_revenue"))),
            "cogs": magnitude(total(amount, after & flag(df, "is_cogs"))),
            "legacy_cogs": magnitude(total(amount, earlier & flag(df, "is_cogs"))),
            "overhead": magnitude(total(amount, inside & flag(df, "is_overhead"))),
            "other_expense": magnitude(total(amount, inside & flag(df, "is_other_expense"))),
            "addbacks": addback_total(amount, inside & flag(df, "sde_addback_flag")),
        },
        prefix,
    )


def get_period_metrics(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Metrics over all rows given; the caller has already picked the period."""
    by = keys(by)
    sums = df.groupBy(*by).agg(*period_sums(df))
    return with_profit_lines(sums).select(*by, *PERIOD_MEASURES)


def get_owner_metrics(
    df: DataFrame,
    owner_period_start: DateLike | None,
    current_date: DateLike,
    owner_revenue_start: DateLike,
    addback_account_overrides: Iterable[str] | None = None,
    exclude_legacy_july_job_costs: bool = True,
    legacy_job_cost_prefixes: Iterable[str] | None = None,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Owner-period metrics with an ownership cut-over. No period start means the earliest row."""
    by = keys(by)
    window = df.where(in_dates(df, "date", owner_period_start, current_date))
    sums = window.groupBy(*by).agg(
        *owner_sums(
            df,
            owner_revenue_start,
            addback_account_overrides,
            exclude_legacy_july_job_costs,
            legacy_job_cost_prefixes,
        )
    )
    return with_profit_lines(sums).select(*by, *OWNER_MEASURES)


def compute_period_kpis(
    df: DataFrame,
    start_date: DateLike,
    end_date: DateLike,
    revenue_start: DateLike | None = None,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Classify, flag and sum one reporting period of a raw transaction detail."""
    by = keys(by)
    first = start_date if revenue_start is None else revenue_start
    flagged = detect_addbacks(
        classify_transactions(df.where(in_dates(df, "date", start_date, end_date)))
    )
    sums = flagged.groupBy(*by).agg(*kpi_sums(flagged, start_date, end_date, first))
    return with_profit_lines(sums).select(*by, *KPI_MEASURES)


def compute_legacy_overhead_addins(
    df: DataFrame,
    legacy_start: DateLike,
    legacy_end: DateLike,
    included_accounts: Iterable[str] | None = None,
    included_row_ids: Iterable[str] | DataFrame | None = None,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """``legacy_overhead``: size of the overhead in the window, optionally of selected rows only.

    Row ids may come as a table with a ``_row_id`` column.
    """
    by = keys(by)
    if not {"date", "amount", "is_overhead"} <= set(df.columns):
        zero = F.lit(0.0).alias("legacy_overhead")
        return df.groupBy(*by).agg(F.count(F.lit(1))).select(*by, zero)
    picked = df.where(in_dates(df, "date", legacy_start, legacy_end) & flag(df, "is_overhead"))
    if included_accounts:
        picked = picked.where(membership(text(df, "account"), included_accounts))
    if isinstance(included_row_ids, DataFrame):
        picked = picked.join(included_row_ids.select("_row_id"), "_row_id", "left_semi")
    elif included_row_ids:
        picked = picked.where(membership(text(df, "_row_id"), included_row_ids))
    return picked.groupBy(*by).agg(magnitude(total(money(picked))).alias("legacy_overhead"))


def legacy_overhead_candidates(df: DataFrame, report_start: DateLike) -> DataFrame:
    """Overhead of the month before the report starts, for the user to choose from."""
    start, end = prior_month(report_start)
    return (
        df.where(
            in_dates(df, "date", start, end) & flag(df, "is_overhead") & flag(df, "is_pnl", True)
        )
        .select("_row_id", "date", "account", "name", "memo", "amount")
        .orderBy("date", "_row_id")
    )


def beside(left: DataFrame, right: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Columns of two metric tables side by side: per key, or of the single row each has."""
    by = keys(by)
    if by:
        mine = right.withColumnsRenamed({k: f"_by_{k}" for k in by})
        same = [left[k].eqNullSafe(mine[f"_by_{k}"]) for k in by]  # rows without a key are a key of their own
        return left.join(mine, same, "left").drop(*[f"_by_{k}" for k in by])
    row = right.agg(F.first(F.struct(*right.columns))).scalar()
    return left.withColumn("_right", row).select("*", "_right.*").drop("_right")


def apply_legacy_overhead_addins(
    metrics: DataFrame,
    legacy_overhead_included_total: float | str | DataFrame = 0.0,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Treat the add-in as further overhead and work the profit lines out again.

    The add-in is a figure, a column of ``metrics``, or a table with ``legacy_overhead``.
    ``legacy_overhead_included`` is always there, 0.0 when nothing was added.
    """
    addin = legacy_overhead_included_total
    if isinstance(addin, DataFrame):
        metrics = beside(metrics, addin.withColumnRenamed("legacy_overhead", "_addin"), by)
        figure = F.col("_addin")
    else:
        figure = F.col(addin) if isinstance(addin, str) else F.lit(float(addin or 0.0))
    adjusted = metrics.withColumn("legacy_overhead_included", F.coalesce(figure, F.lit(0.0)))
    adjusted = adjusted.withColumn(
        "overhead",
        F.coalesce(F.col("overhead"), F.lit(0.0)) + F.col("legacy_overhead_included"),
    ).drop("_addin")
    return with_profit_lines(adjusted)


def reconciliation_bridge(
    metrics: DataFrame,
    labels: Sequence[str],
    net: str = "qb_net_profit",
    addin: str = "legacy_overhead_included",
    adjusted: str = "net_profit",
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Three labelled steps from the reported net profit to the adjusted one."""
    by = keys(by)
    steps = [F.col(net), F.lit(0.0) - F.col(addin), F.col(adjusted)]
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("step"), step.alias("amount"))
            for i, (label, step) in enumerate(zip(labels, steps, strict=True))
        ]
    )
    return metrics.select(*by, F.inline(rows))


def _measures(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in by]


def monthly_rate(measure: Column, days: int) -> Column:
    """Rate per average month; zero when the period has no days."""
    return measure / days * DAYS_PER_MONTH if days > 0 else F.lit(0.0)


def projected(actual: Column, rate: Column, days_remaining: int) -> Column:
    """Actual plus the monthly rate over the days left, if any are."""
    return actual + rate / DAYS_PER_MONTH * max(days_remaining, 0)


def calculate_run_rates(
    metrics: DataFrame, days_in_period: int, by: str | Sequence[str] = ()
) -> DataFrame:
    """Monthly rate of every measure."""
    by = keys(by)
    return metrics.select(
        *by, *[monthly_rate(F.col(c), days_in_period).alias(c) for c in _measures(metrics, by)]
    )


def forecast_year_1(
    owner_metrics: DataFrame,
    run_rates: DataFrame,
    days_remaining: int,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Actuals plus the run rate over the days left, and the months left."""
    by = keys(by)
    rates = [c for c in _measures(run_rates, by) if c in owner_metrics.columns]
    both = beside(
        owner_metrics, run_rates.select(*by, *[F.col(c).alias(f"_rate_{c}") for c in rates]), by
    )

    def total_of(measure: str) -> Column:
        rate = F.col(f"_rate_{measure}") if measure in rates else F.lit(0.0)
        return projected(F.col(measure), F.coalesce(rate, F.lit(0.0)), days_remaining)

    out = both.select(*by, *[total_of(c).alias(c) for c in _measures(owner_metrics, by)])
    return out.withColumns(
        {
            "gross_profit": F.col("revenue") - F.col("cogs"),
            "months_remaining": F.lit(max(days_remaining, 0) / DAYS_PER_MONTH),
        }
    )
