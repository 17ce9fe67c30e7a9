"""The dashboard: report-window metrics, add-in, run rates, projection, payload.

All figures of all steps come from one pass over the ledger and one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.accounts import JOB_COST_PREFIXES
from ..functions.columns import (
    DateLike,
    as_date,
    flag,
    in_dates,
    keys,
    magnitude,
    membership,
    money,
    text,
    total,
)
from ..functions.dates import days_between, prior_month
from ..operators.addbacks import RuleLike, detect_addbacks
from ..operators.classify import classify_transactions
from ..operators.metrics import (
    PERIOD_MEASURES,
    monthly_rate,
    period_sums,
    projected,
    with_profit_lines,
)
from ..operators.monthly import compute_monthly_kpis, months_from
from ..sources.rules import default_rules


def flagged_ledger(
    ledger: DataFrame,
    cogs_prefixes: Iterable[str] | None = None,
    custom_tokens: Iterable[str] | None = None,
    rules: Iterable[RuleLike] | None = None,
) -> DataFrame:
    """Classes, then tokens, then the built-in rules followed by the given ones."""
    classified = classify_transactions(ledger, cogs_prefixes)
    return detect_addbacks(classified, custom_tokens, [*default_rules(), *(rules or ())])


def report_window(flagged: DataFrame, report_start: DateLike, today: DateLike) -> DataFrame:
    """Profit-and-loss rows of the report period."""
    return flagged.where(in_dates(flagged, "date", report_start, today) & flag(flagged, "is_pnl", True))


def dashboard_metrics(
    flagged: DataFrame,
    report_start: DateLike,
    today: DateLike,
    year_1_end: DateLike,
    selected_row_ids: Iterable[str] | DataFrame = (),
    by: str | Sequence[str] = (),
) -> DataFrame:
    """One row per key: metrics, ``adjusted_*`` by the add-in, ``monthly_*`` rates, ``proj_*``.

    The add-in is the overhead of the month before the report, of the selected rows only: none
    selected, none added. Rates come from the unadjusted metrics, the projection starts from the
    adjusted ones.
    """
    by = keys(by)
    legacy_start, legacy_end = prior_month(report_start)
    report = in_dates(flagged, "date", report_start, today) & flag(flagged, "is_pnl", True)
    legacy = in_dates(flagged, "date", legacy_start, legacy_end) & flag(flagged, "is_overhead")

    df = flagged.where(in_dates(flagged, "date", legacy_start, today))
    if isinstance(selected_row_ids, DataFrame):
        marks = selected_row_ids.select("_row_id").distinct().withColumn("_picked", F.lit(True))
        df = df.join(marks, "_row_id", "left")
        picked = flag(df, "_picked")
    else:
        picked = membership(text(df, "_row_id"), selected_row_ids)

    sums = df.groupBy(*by).agg(
        *period_sums(flagged, report),
        magnitude(total(money(df), legacy & picked)).alias("legacy_overhead_included"),
        F.count(F.when(legacy & picked, F.lit(1))).alias("legacy_overhead_rows"),
    )
    metrics = with_profit_lines(sums)
    addin = F.col("legacy_overhead_included")
    adjusted = {
        **{c: F.col(c) for c in ("revenue", "cogs", "other_expense", "addbacks", "gross_profit")},
        "overhead": F.col("overhead") + addin,
        "net_profit": F.col("revenue")
        - (F.col("cogs") + F.col("overhead") + addin + F.col("other_expense")),
    }
    adjusted["sde"] = adjusted["net_profit"] + F.col("addbacks")

    elapsed, left = days_between(report_start, today), days_between(today, year_1_end)
    rates = {c: monthly_rate(F.col(c), elapsed) for c in PERIOD_MEASURES}
    outlook = {c: projected(adjusted[c], rates[c], left) for c in PERIOD_MEASURES}
    outlook["gross_profit"] = outlook["revenue"] - outlook["cogs"]
    return metrics.select(
        *by,
        *PERIOD_MEASURES,
        "legacy_overhead_included",
        "legacy_overhead_rows",
        *[adjusted[c].alias(f"adjusted_{c}") for c in ("overhead", "net_profit", "sde")],
        *[rates[c].alias(f"monthly_{c}") for c in PERIOD_MEASURES],
        *[outlook[c].alias(f"proj_{c}") for c in PERIOD_MEASURES],
    )


def dashboard_payload(
    metrics: DataFrame,
    report_start: DateLike,
    today: DateLike,
    year_1_end: DateLike,
    cogs_prefixes: Iterable[str] | None = None,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """``payload``: the machine-readable record of a dashboard, as nested structs."""
    start, end = prior_month(report_start)
    prefixes = sorted(JOB_COST_PREFIXES if cogs_prefixes is None else set(cogs_prefixes))

    def named(**fields: Column | str) -> Column:
        return F.struct(
            *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()]
        )

    return metrics.select(
        *keys(by),
        named(
            config=named(
                report_start=F.lit(str(as_date(report_start))),
                current_date=F.lit(str(as_date(today))),
                year_1_end=F.lit(str(as_date(year_1_end))),
                cogs_prefixes=F.array(*[F.lit(p) for p in prefixes]),
                july_overhead_window=named(start=F.lit(str(start)), end=F.lit(str(end))),
                july_overhead_selected_count="legacy_overhead_rows",
            ),
            dashboard_metrics=named(
                ytd_sde="adjusted_sde",
                proj_sde="proj_sde",
                ytd_net="adjusted_net_profit",
                proj_net="proj_net_profit",
            ),
            qb_pnl_metrics_report_window=named(
                net_profit="net_profit",
                sde="sde",
                revenue="revenue",
                cogs="cogs",
                overhead="overhead",
                other_expense="other_expense",
            ),
            reconciliation_bridge=named(
                qb_net_start_plus="net_profit",
                legacy_overhead_included="legacy_overhead_included",
                adjusted_net="adjusted_net_profit",
            ),
            run_rates=named(
                monthly_revenue="monthly_revenue",
                monthly_net="monthly_net_profit",
                monthly_sde="monthly_sde",
            ),
        ).alias("payload"),
    )


def dashboard_months(
    flagged: DataFrame, report_start: DateLike, today: DateLike, by: str | Sequence[str] = ()
) -> DataFrame:
    """Monthly table of the report window."""
    monthly = compute_monthly_kpis(report_window(flagged, report_start, today), report_start, by)
    return months_from(monthly, report_start)


def write_json(df: DataFrame, path: str) -> None:
    """Nested records as JSON lines."""
    df.write.mode("overwrite").json(path)
