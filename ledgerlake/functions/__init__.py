from .accounts import (
    JOB_COST_PREFIXES,
    account_code_prefix,
    display_classification,
    extract_account_prefix,
    is_pnl_account_type,
)
from .amounts import currency, parse_amount, to_number
from .columns import in_dates, in_midnights, magnitude, round_half_even, safe_divide
from .dates import (
    days_between,
    month_label,
    month_start,
    parse_date,
    prior_month,
    prior_month_end,
    prior_month_start,
)
from .text import contains_text, describe, redact

__all__ = [
    "JOB_COST_PREFIXES",
    "account_code_prefix",
    "contains_text",
    "currency",
    "days_between",
    "describe",
    "display_classification",
    "extract_account_prefix",
    "in_dates",
    "in_midnights",
    "is_pnl_account_type",
    "magnitude",
    "month_label",
    "month_start",
    "parse_amount",
    "parse_date",
    "prior_month",
    "prior_month_end",
    "prior_month_start",
    "redact",
    "round_half_even",
    "safe_divide",
    "to_number",
]
