"""Quick looks at a ledger: totals, counts, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, keys, money, named, total
from ..functions.text import contains_text


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of values present in every column."""
    return df.agg(*[F.count(named(c)).alias(c) for c in df.columns])


def value_counts(df: DataFrame, column: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Values and how often they occur, most frequent first; missing ones are not counted."""
    by = keys(by)
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(*by, F.desc("count"), column)
    )


def ledger_totals(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Row count, first and last date, signed total, and raw total of income types."""
    income = contains_text(F.col("account_type"), "income")
    return df.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        total(money(df)).alias("total_amount"),
        total(money(df), income).alias("income_amount"),
    )


def distinct_accounts(df: DataFrame, limit: int = 10) -> DataFrame:
    """The first accounts in name order."""
    return df.select("account").distinct().orderBy("account").limit(limit)


def addback_totals(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Number and signed total of the flagged rows."""
    flagged = flag(df, "sde_addback_flag")
    return df.groupBy(*keys(by)).agg(
        F.count(F.when(flagged, F.lit(1))).alias("addback_count"),
        total(money(df), flagged).alias("addback_amount"),
    )


def addback_listing(df: DataFrame, limit: int = 10) -> DataFrame:
    """The first flagged rows by date."""
    return (
        df.where(flag(df, "sde_addback_flag"))
        .orderBy("date", "_row_id")
        .select("_row_id", "date", "name", "memo", "amount", "sde_addback_reason")
        .limit(limit)
    )


def preview(df: DataFrame, order: Sequence[str], limit: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(limit)
