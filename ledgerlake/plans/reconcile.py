"""Reconciliations from start to end: from export files, and from a loaded ledger and register."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators.matching import (
    MatchResult,
    match_bank_signed_tolerance,
    match_summary,
    reconcile_transactions,
)
from ..sources.bank import load_bank_export, normalize_bank_register, normalize_qb_ledger_for_bank
from ..sources.ledger import load_qb_export


class Reconciliation(NamedTuple):
    result: MatchResult
    summary: DataFrame


def reconcile_exports(
    spark: SparkSession,
    bank_paths: str | Sequence[str],
    ledger_paths: str | Sequence[str],
    account_token: str = "PNC",
    date_tolerance_days: int = 14,
    **options,
) -> Reconciliation:
    """Bank export against the ledger export's rows on the bank account, both in file order.

    Amounts match within the tolerance, or with the sign inverted.
    """
    bank = load_bank_export(spark, bank_paths, with_ids=True).withColumnRenamed(
        "transaction_description", "description"
    )
    ledger = load_qb_export(spark, ledger_paths, account_token)
    result = match_bank_signed_tolerance(
        bank, ledger, date_tolerance_days, qb_order=["_pos"], bank_order=["_pos"], **options
    )
    return Reconciliation(result, match_summary(result))


def reconcile_ledger(
    ledger: DataFrame,
    bank: DataFrame,
    date_tolerance_days: int = 14,
    *,
    by: str | Sequence[str] = (),
    qb_id: str = "_row_id",
    bank_id: str = "bank_id",
    **options,
) -> Reconciliation:
    """Normalise both sides, match to the cent, and sum up. Rows are served in date order."""
    keys = [by] if isinstance(by, str) else list(by)
    qb_side = normalize_qb_ledger_for_bank(ledger, keep=[*keys, qb_id])
    bank_side = normalize_bank_register(bank, keep=[*keys, bank_id])
    result, summary = reconcile_transactions(
        bank_side,
        qb_side,
        date_tolerance_days,
        by=by,
        qb_id=qb_id,
        bank_id=bank_id,
        qb_order=["date", qb_id],
        bank_order=["date", bank_id],
        **options,
    )
    return Reconciliation(result, summary)
