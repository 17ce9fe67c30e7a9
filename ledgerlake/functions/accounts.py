"""What an account's type, name and code say about it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import any_of, strip

# Words in an account type that mark the balance sheet. They win over the list below.
BALANCE_SHEET_WORDS = (
    "bank",
    "accounts payable",
    "accounts receivable",
    "credit card",
    "fixed asset",
    "other current asset",
    "other current liability",
    "long term liability",
    "equity",
)

# Words in an account type that mark profit and loss.
# "other income" and "other expense" need no entry of their own: the shorter words cover them.
PROFIT_AND_LOSS_WORDS = ("income", "expense", "cost of goods sold", "cogs")

# Account codes that hold job costs.
JOB_COST_PREFIXES = ("704", "705", "706", "707", "708")


def holds_any(lowered: Column, words: Iterable[str]) -> Column:
    return any_of(lowered.contains(word) for word in words)


def is_pnl_account_type(account_type: Column) -> Column:
    """True for profit-and-loss types; a missing or blank type is given the benefit of the doubt."""
    return is_pnl_kind(F.lower(F.coalesce(account_type, F.lit(""))))


def is_pnl_kind(kind: Column) -> Column:
    """The same for a type already in lower case and not null."""
    return (
        F.when(holds_any(kind, BALANCE_SHEET_WORDS), F.lit(False))
        .when(holds_any(kind, PROFIT_AND_LOSS_WORDS), F.lit(True))
        .otherwise(strip(kind).isin("", "nan"))
    )


def account_code_prefix(account: Column) -> Column:
    """First three digits of the account code: ``7051 x`` gives ``705``."""
    return F.nullif(F.regexp_extract(account, r"(?U)^\s*(\d{3})", 1), F.lit(""))


def extract_account_prefix(account: Column) -> Column:
    """All leading digits of the account code: ``7051 x`` gives ``7051``."""
    return F.nullif(F.regexp_extract(account, r"(?U)^\s*(\d+)", 1), F.lit(""))


def display_classification(account_type: Column) -> Column:
    """Bucket shown in account lists. Coarser than, and not the same as, transaction classes."""
    lowered = F.lower(F.coalesce(account_type, F.lit("")))
    return (
        F.when(holds_any(lowered, ("income", "revenue")), "revenue")
        .when(lowered.contains("cost of goods sold"), "cogs")
        .when(lowered.contains("other expense"), "other")
        .when(holds_any(lowered, ("expense", "overhead")), "overhead")
        .otherwise("other")
    )
