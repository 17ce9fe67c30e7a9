"""Account roll-up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.accounts import display_classification
from ..functions.columns import DateLike, in_midnights, keys, membership, money, total


def build_account_summary(
    df: DataFrame,
    owner_period_start: DateLike,
    current_date: DateLike,
    addback_accounts: Iterable[str] | None = None,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """One row per account and type, missing ones included, with its signed total."""
    by = keys(by)
    if "date" in df.columns:
        df = df.where(in_midnights(df, "date", owner_period_start, current_date))
    return (
        df.groupBy(*by, "account", "account_type")
        .agg(total(money(df)).alias("ytd_amount"))
        .select(
            *by,
            "account",
            "account_type",
            display_classification(F.col("account_type")).alias("classification"),
            "ytd_amount",
            membership(F.col("account"), addback_accounts).alias("is_addback"),
        )
    )
