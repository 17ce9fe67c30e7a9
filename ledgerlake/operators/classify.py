"""Transaction classes. Narrow projections only: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.accounts import (
    JOB_COST_PREFIXES,
    extract_account_prefix,
    holds_any,
    is_pnl_kind,
)
from ..functions.columns import membership, strip, text

REVENUE, COGS, OVERHEAD, OTHER = "Revenue", "COGS", "Overhead", "Other"


def classify_transactions(df: DataFrame, cogs_prefixes: Iterable[str] | None = None) -> DataFrame:
    """Add the profit-and-loss flags, the account prefix and the class name.

    At most one of the four class flags holds. Precedence: revenue, other expense, cost of goods
    sold, overhead. Job costs booked as plain expenses are recognised by their account prefix.
    """
    prefixes = JOB_COST_PREFIXES if cogs_prefixes is None else cogs_prefixes
    kind, account = F.col("_kind"), F.col("_account")
    is_set = {name: F.col(name) for name in ("is_pnl", "is_revenue", "is_other_expense", "is_cogs")}

    expense_like = (
        is_set["is_pnl"]
        & holds_any(kind, ("expense", "cost of goods sold", "cogs"))
        & ~is_set["is_revenue"]
        & ~is_set["is_other_expense"]
    )
    job_cost = (
        kind.contains("cost of goods sold")
        | (strip(kind) == "cogs")
        | membership(F.col("account_prefix"), prefixes)
    )
    return (
        df.withColumns({"_kind": F.lower(text(df, "account_type")), "_account": text(df, "account")})
        .withColumns(
            {"is_pnl": is_pnl_kind(kind), "account_prefix": extract_account_prefix(account)}
        )
        .withColumn(
            "is_revenue",
            is_set["is_pnl"] & (kind.contains("income") | F.lower(account).contains("income")),
        )
        .withColumn(
            "is_other_expense",
            is_set["is_pnl"] & ~is_set["is_revenue"] & holds_any(kind, ("other expense", "other income")),
        )
        .withColumn("_expense", expense_like)
        .withColumn("is_cogs", F.col("_expense") & job_cost)
        .withColumn("is_overhead", F.col("_expense") & ~F.col("is_cogs"))
        .withColumn(
            "classification",
            F.when(F.col("is_revenue"), REVENUE)
            .when(F.col("is_cogs"), COGS)
            .when(F.col("is_overhead"), OVERHEAD)
            .when(F.col("is_other_expense"), OTHER)
            .when(F.col("is_pnl") & (kind == ""), "Unclassified")
            .when(F.col("is_pnl"), OTHER)
            .otherwise("Balance Sheet"),
        )
        .drop("_kind", "_account", "_expense")
    )
