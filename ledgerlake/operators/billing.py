"""Cost-plus job invoices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    DateLike,
    as_date,
    in_midnights,
    keys,
    money,
    round_half_even,
    total,
)

INVOICE_COLUMNS = (
    "job", "period", "materials", "labor", "supervision", "overhead_pct", "profit_pct",
    "overhead_amount", "profit_amount", "invoice_total",
)


@dataclass(frozen=True)
class JobBillingConfig:
    """Mark-ups of one job as fractions: 0.10 is ten per cent."""

    job: str
    overhead_pct: float
    profit_pct: float
    contract_type: str = "simple"


def compute_period_billing(
    costs: DataFrame,
    configs: DataFrame | Iterable[JobBillingConfig],
    period_start: DateLike,
    period_end: DateLike,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """One invoice per configured job; jobs without costs bill zero, jobs without a config do not.

    Costs are summed per job first, so the join sees one row per job on either side.
    """
    if not isinstance(configs, DataFrame):
        configs = costs.sparkSession.createDataFrame(
            [asdict(c) for c in configs],
            "job string, overhead_pct double, profit_pct double, contract_type string",
        )
    on = [*keys(by), "job"]
    amount = money(costs)
    sums = (
        costs.where(in_midnights(costs, "date", period_start, period_end))
        .groupBy(*on)
        .agg(
            total(amount, F.col("cost_type") == "material").alias("materials"),
            total(amount, F.col("cost_type") == "labor").alias("labor"),
            total(amount, F.col("cost_type") == "supervision").alias("supervision"),
        )
    )
    kinds = ("materials", "labor", "supervision")
    label = f"{as_date(period_start)} → {as_date(period_end)}"
    base = F.col("materials") + F.col("labor") + F.col("supervision")
    return (
        configs.select(*on, "overhead_pct", "profit_pct")
        .join(sums, on, "left")
        .withColumns({k: round_half_even(F.coalesce(F.col(k), F.lit(0.0))) for k in kinds})
        .withColumn("overhead_amount", round_half_even(base * F.col("overhead_pct")))
        .withColumn(
            "profit_amount",
            round_half_even((base + F.col("overhead_amount")) * F.col("profit_pct")),
        )
        .withColumn(
            "invoice_total",
            round_half_even(base + F.col("overhead_amount") + F.col("profit_amount")),
        )
        .withColumn("period", F.lit(label))
        .select(*keys(by), *INVOICE_COLUMNS)
    )


def compute_job_invoice(
    costs: DataFrame, config: JobBillingConfig, period_start: DateLike, period_end: DateLike
) -> DataFrame:
    """The invoice of a single job."""
    return compute_period_billing(
        costs.where(F.col("job") == config.job), [config], period_start, period_end
    )
