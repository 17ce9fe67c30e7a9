"""Bank exports, and both sides of a bank reconciliation in their common shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import keys, text
from ..functions.text import describe
from .layout import (
    BLOCK,
    FILE,
    LINE,
    first_present,
    read_exports,
    snake_columns,
    with_file_order,
)
from .ledger import number_of, timestamp_of

# Names under which a bank register's date and description may appear, best first.
REGISTER_DATE_COLUMNS = ("date", "transaction_date", "posting_date")
REGISTER_TEXT_COLUMNS = ("description", "transaction_description", "memo")


def clean_bank_export(raw: DataFrame) -> DataFrame:
    """``Transaction Date / Transaction Description / Amount`` rows, parsed; nothing is dropped."""
    df = snake_columns(raw)
    return df.withColumns(
        {
            "date": timestamp_of(df, "transaction_date"),
            "amount": F.coalesce(number_of(df, "amount", "export"), F.lit(0.0)),
        }
    )


def load_bank_export(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    multiline: bool = True,
    same_layout: bool = False,
    with_ids: bool = False,
) -> DataFrame:
    """Bank CSV exports; ``with_ids`` adds ``bank_id`` and ``_pos``, numbering rows in file order."""
    df = clean_bank_export(read_exports(spark, paths, multiline=multiline, same_layout=same_layout))
    if with_ids:
        df = with_file_order(df).withColumn("bank_id", F.col("_pos").cast("string"))
    return df.drop(FILE, BLOCK, LINE)


def normalize_bank_register(df: DataFrame, keep: str | Sequence[str] = ()) -> DataFrame:
    """Bank register under any usual header spelling to ``date, amount, description, source``.

    ``keep`` names further columns to carry along, such as entity keys and row order.
    """
    bank = snake_columns(df)
    date_column = first_present(bank.columns, REGISTER_DATE_COLUMNS)
    if date_column is None:
        raise ValueError("Bank register is missing a date-like column.")
    if "amount" not in bank.columns:
        raise ValueError("Bank register is missing an 'amount' column.")
    text_column = first_present(bank.columns, REGISTER_TEXT_COLUMNS)
    return _reconcilable(
        bank.select(
            *keys(keep),
            timestamp_of(bank, date_column).alias("date"),
            F.coalesce(number_of(bank, "amount", "register"), F.lit(0.0)).alias("amount"),
            (text(bank, text_column) if text_column else F.lit("")).alias("description"),
            F.lit("bank").alias("source"),
        )
    )


normalize_bank_export = normalize_bank_register


def normalize_qb_ledger_for_bank(df: DataFrame, keep: str | Sequence[str] = ()) -> DataFrame:
    """Ledger side of a reconciliation: ``date, amount, description, account, source``.

    The account type is left out. An accrual statement needs the ledger itself.
    """
    for needed in ("date", "amount"):
        if needed not in df.columns:
            raise ValueError(f"QB ledger is missing required column: {needed}")
    return _reconcilable(
        df.select(
            *keys(keep),
            timestamp_of(df, "date").alias("date"),
            F.coalesce(number_of(df, "amount"), F.lit(0.0)).alias("amount"),
            describe(text(df, "name"), text(df, "memo")).alias("description"),
            text(df, "account").alias("account"),
            F.lit("qb").alias("source"),
        )
    )


def _reconcilable(df: DataFrame) -> DataFrame:
    return df.where(F.col("date").isNotNull() & (F.col("amount") != 0.0))
