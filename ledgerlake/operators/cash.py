"""Cash-basis and accrual-basis results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DateLike, in_dates, keys, magnitude, money, text, total

CASH = ("revenue_cash", "expenses_cash", "net_cash")
ACCRUAL = ("revenue_accrual", "expenses_accrual", "net_accrual")


def compute_cash_basis_pl(
    bank: DataFrame, start_date: DateLike, end_date: DateLike, by: str | Sequence[str] = ()
) -> DataFrame:
    """Money in, money out and the difference, from the bank register."""
    by = keys(by)
    amount = money(bank)
    return (
        bank.where(in_dates(bank, "date", start_date, end_date))
        .groupBy(*by)
        .agg(
            total(amount, amount > 0).alias("revenue_cash"),
            magnitude(total(amount, amount < 0)).alias("expenses_cash"),
        )
        .withColumn("net_cash", F.col("revenue_cash") - F.col("expenses_cash"))
    )


def compute_accrual_pl_from_qb(
    ledger: DataFrame, start_date: DateLike, end_date: DateLike, by: str | Sequence[str] = ()
) -> DataFrame:
    """Revenue with its sign flipped, less cost of goods sold and expenses, from account types.

    A type that names both an expense and cost of goods sold counts under each.
    """
    by = keys(by)
    amount = money(ledger)
    kind = F.lower(text(ledger, "account_type"))
    income = kind.contains("income")
    cogs = magnitude(total(amount, kind.contains("cost of goods sold")))
    expenses = magnitude(total(amount, kind.contains("expense") & ~income))
    return (
        ledger.where(in_dates(ledger, "date", start_date, end_date))
        .groupBy(*by)
        .agg(
            (F.lit(0.0) - total(amount, income)).alias("revenue_accrual"),
            (cogs + expenses).alias("expenses_accrual"),
        )
        .withColumn("net_accrual", F.col("revenue_accrual") - F.col("expenses_accrual"))
    )


def compute_cash_vs_accrual_summary(
    ledger: DataFrame,
    bank: DataFrame,
    start_date: DateLike,
    end_date: DateLike,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Both results and accrual less cash, per key found on either side.

    The two sides are stacked and summed rather than joined: one row per key each, and a key
    missing on one side counts as zero there.
    """
    by = keys(by)
    cash = compute_cash_basis_pl(bank, start_date, end_date, by)
    accrual = compute_accrual_pl_from_qb(ledger, start_date, end_date, by)
    both = cash.unionByName(accrual, allowMissingColumns=True)
    return (
        both.groupBy(*by)
        .agg(*[total(F.col(c)).alias(c) for c in (*CASH, *ACCRUAL)])
        .withColumns(
            {
                "revenue_diff": F.col("revenue_accrual") - F.col("revenue_cash"),
                "expenses_diff": F.col("expenses_accrual") - F.col("expenses_cash"),
                "net_diff": F.col("net_accrual") - F.col("net_cash"),
            }
        )
    )
