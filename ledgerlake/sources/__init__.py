from .bank import (
    clean_bank_export,
    load_bank_export,
    normalize_bank_export,
    normalize_bank_register,
    normalize_qb_ledger_for_bank,
)
from .green_sheets import load_green_sheets
from .layout import normalize_ledger_columns
from .ledger import (
    clean_ledger,
    clean_transaction_detail,
    filter_account,
    ledger_rejects,
    load_ledger,
    load_ledger_rejects,
    load_qb_export,
    load_transaction_detail,
)
from .rules import (
    AddbackRule,
    default_rules,
    load_rules,
    parse_rule,
    rules_table,
    rules_to_jsonable,
    save_rules,
)

__all__ = [
    "AddbackRule",
    "clean_bank_export",
    "clean_ledger",
    "clean_transaction_detail",
    "default_rules",
    "filter_account",
    "ledger_rejects",
    "load_bank_export",
    "load_green_sheets",
    "load_ledger",
    "load_ledger_rejects",
    "load_qb_export",
    "load_rules",
    "load_transaction_detail",
    "normalize_bank_export",
    "normalize_bank_register",
    "normalize_ledger_columns",
    "normalize_qb_ledger_for_bank",
    "parse_rule",
    "rules_table",
    "rules_to_jsonable",
    "save_rules",
]
