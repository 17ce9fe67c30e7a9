"""General-ledger and transaction-detail exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import parse_amount, to_number
from ..functions.columns import named, strip, text
from ..functions.dates import parse_date
from ..functions.text import contains_text
from .layout import (
    BLOCK,
    FILE,
    LINE,
    WIDE,
    first_present,
    normalize_ledger_columns,
    read_exports,
    with_file_order,
    with_place,
)

# Names under which the posting date may appear, best first.
DATE_COLUMNS = ("date", "txn_date", "transaction_date", "posting_date")
TEXT_COLUMNS = ("account", "account_type", "name", "memo")


def timestamp_of(df: DataFrame, name: str) -> Column:
    """Text is parsed, dates and timestamps are taken as they are."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_date(F.col(name))
    return F.col(name).cast("timestamp_ntz")


def number_of(df: DataFrame, name: str, style: str | None = None) -> Column:
    """Text is parsed (strictly, or in the given money style), numbers are taken as they are."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_number(F.col(name)) if style is None else parse_amount(F.col(name), style)
    return F.col(name).cast("double")


def _signed_amount(df: DataFrame) -> Column:
    """The amount column, else debit less credit; what cannot be read counts as zero."""

    def figure(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0)
        return F.coalesce(number_of(df, name, "ledger"), F.lit(0.0))

    return figure("amount") if "amount" in df.columns else figure("debit") - figure("credit")


# Why a row of an export is left out: more cells than the header, nothing in it, no date, no date that can be read.
REJECTS = ("too_wide", "blank", "undated", "unreadable_date")


def _assessed(raw: DataFrame) -> DataFrame:
    """Rows in the ledger schema, with the date's text and the reason to leave them out (null: none)."""
    df = normalize_ledger_columns(raw)
    date_column = first_present(df.columns, DATE_COLUMNS)
    dated = timestamp_of(df, date_column) if date_column else F.lit(None).cast("timestamp_ntz")
    said = text(df, date_column) if date_column else F.lit("")
    cells = [c for c in df.columns if c not in (FILE, BLOCK, LINE, WIDE)]
    empty = strip(F.concat_ws("", *[named(c).cast("string") for c in cells])) == ""
    blanks = {c: F.lit("") for c in TEXT_COLUMNS if c not in df.columns}
    out = df.withColumns({"date": dated, "amount": _signed_amount(df), **blanks, "_said": said, "_empty": empty})
    reason = (
        F.when(F.col(WIDE).isNotNull() if WIDE in df.columns else F.lit(False), "too_wide")
        .when(F.col("date").isNotNull(), None)
        .when(F.col("_empty"), "blank")
        .when(strip(F.col("_said")) == "", "undated")
        .otherwise("unreadable_date")
    )
    return out.withColumn("_reject", reason).drop("_empty")


def clean_ledger(raw: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Raw ledger rows under any header spelling to the ledger schema. No shuffle.

    Undated rows (blank lines, subtotals, titles) are dropped. Source columns beyond the
    schema are kept as they are. An ``observation`` gets the number of rows kept, and of those left out for
    each reason in ``REJECTS``, in the same pass: ``observation.get`` has them after the first action.
    """
    df = _assessed(raw)
    if observation is not None:
        why = F.col("_reject")
        counts = [F.count(F.when(why == reason, 1)).alias(reason) for reason in REJECTS]
        df = df.observe(observation, F.count(F.when(why.isNull(), 1)).alias("kept"), *counts)
    return df.where(F.col("_reject").isNull()).drop("_said", "_reject", WIDE)


def ledger_rejects(raw: DataFrame) -> DataFrame:
    """The rows that ``clean_ledger`` leaves out: ``reason``, the date's text, and the row as JSON, ``record``."""
    df = _assessed(raw).where(F.col("_reject").isNotNull())
    own = [c for c in normalize_ledger_columns(raw).columns if c not in (FILE, BLOCK, LINE, WIDE)]
    row = F.to_json(F.struct(*[named(c).cast("string").alias(c) for c in own if c != "amount"]))
    if WIDE in df.columns:
        row = F.coalesce(F.col(WIDE), row)
    places = [named(FILE).alias("file")] if FILE in df.columns else []
    return df.select(F.col("_reject").alias("reason"), F.col("_said").alias("date_text"), row.alias("record"), *places)


def load_ledger(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    multiline: bool = True,
    same_layout: bool = False,
    dense_ids: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    """Ledger CSV exports to the ledger schema with ``_row_id`` and, for ordering, ``_pos``.

    ``dense_ids`` numbers rows 0..n-1 in the order of all files. Without it the id is the file and the
    row's number in it, which depends on that file alone, and there is no ``_pos``. For either the files are
    read twice: rows are counted first. ``observation`` gets counts of kept and left out rows (``clean_ledger``).
    """
    raw = read_exports(
        spark,
        paths,
        header_words=("date", "account"),
        multiline=multiline,
        same_layout=same_layout,
        wide="drop" if observation is None else "mark",
    )
    df = clean_ledger(raw, observation)
    if dense_ids:
        return (
            with_file_order(df)
            .withColumn("_row_id", F.col("_pos").cast("string"))
            .drop(FILE, BLOCK, LINE)
        )
    return with_place(df, "_row_id").drop(FILE, BLOCK, LINE)


def load_ledger_rejects(
    spark: SparkSession, paths: str | Sequence[str], *, multiline: bool = True, same_layout: bool = False
) -> DataFrame:
    """What ``load_ledger`` leaves out of the same files, and why."""
    words = ("date", "account")
    return ledger_rejects(
        read_exports(spark, paths, header_words=words, multiline=multiline, same_layout=same_layout, wide="mark")
    )


def load_qb_export(
    spark: SparkSession, paths: str | Sequence[str], account_token: str = "PNC", **options
) -> DataFrame:
    """The ledger rows booked on the bank account whose name holds ``account_token``."""
    return filter_account(load_ledger(spark, paths, **options), account_token)


def filter_account(df: DataFrame, account_token: str) -> DataFrame:
    return df.where(contains_text(F.col("account"), account_token))


# Transaction-detail columns that the metrics use.
DETAIL_COLUMNS = ("date", "name", "memo", "account", "class", "amount", "account_type")


def clean_transaction_detail(raw: DataFrame) -> DataFrame:
    """Transaction-detail rows with a type; summary rows have none and are dropped.

    Spark names are case-insensitive, so each source column appears once, in snake case.
    """
    df = normalize_ledger_columns(raw)
    for needed in ("date", "amount"):
        if needed not in df.columns:
            raise ValueError(f"No {needed} column found in transaction detail")
    blanks = {c: text(df, c) for c in DETAIL_COLUMNS if c in df.columns}
    figures = {
        "date": timestamp_of(df, "date"),
        "amount": F.coalesce(number_of(df, "amount"), F.lit(0.0)),
    }
    typed = df.where(F.col("type").isNotNull()) if "type" in df.columns else df
    return typed.withColumns({**blanks, **figures})


def load_transaction_detail(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    multiline: bool = True,
    same_layout: bool = False,
) -> DataFrame:
    raw = read_exports(spark, paths, multiline=multiline, same_layout=same_layout)
    if "type" not in raw.columns:
        raise ValueError("Failed to load transaction detail: no Type column")
    return clean_transaction_detail(raw.drop(FILE, BLOCK, LINE))
