"""Money text to numbers and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal literal. Guards the cast, which would also take Java suffixes such as 5d.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

AMOUNT_STYLES = ("ledger", "register", "export")


def to_number(column: Column) -> Column:
    """Strict decimal parse; anything else is null."""
    trimmed = F.btrim(column.cast("string"))
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def _unbracket(column: Column) -> Column:
    """Accounting negatives: ``(12.30)`` reads as ``-12.30``."""
    return F.regexp_replace(column, r"^\((.*)\)$", "-$1")


def parse_amount(column: Column, style: str = "ledger") -> Column:
    """Money text to double, null when unreadable.

    ``ledger``    drops ``$ ,`` and outer blanks; brackets are not understood.
    ``register``  drops ``$ ,`` and every blank; brackets are negative.
    ``export``    as ledger, then a leading ``"- "`` or ``"+ "`` sign, else brackets.
    """
    if style not in AMOUNT_STYLES:
        raise ValueError(f"style must be one of {AMOUNT_STYLES}, got {style!r}")
    bare = F.translate(column.cast("string"), "$,", "")
    if style == "ledger":
        return to_number(bare)
    if style == "register":
        return to_number(_unbracket(F.translate(bare, " ", "")))
    bare = F.btrim(bare)
    signed = (
        F.when(bare.startswith("- "), F.concat(F.lit("-"), F.substr(bare, F.lit(3))))
        .when(bare.startswith("+ "), F.substr(bare, F.lit(3)))
        .otherwise(_unbracket(bare))
    )
    return to_number(signed)


def currency(column: Column) -> Column:
    """Display form ``$1,234.50``; a dash when there is no value."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(column.cast("double"), 2)), F.lit("-"))
