"""Job-cost sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip, text
from .layout import snake_columns
from .ledger import number_of, timestamp_of

# Source spelling -> our name, used only where our name is not there already.
RENAMES = {
    "project": "job",
    "name": "vendor_or_employee",
    "total": "amount",
    "memo": "description",
    "reference": "ref",
}

COLUMNS = (
    "job", "date", "amount", "cost_type", "vendor_or_employee", "description", "sov_line", "ref",
)


def load_green_sheets(df: DataFrame) -> DataFrame:
    """Job costs under any usual header spelling, typed; absent columns are null."""
    sheet = snake_columns(df)
    for source, target in RENAMES.items():
        if source in sheet.columns and target not in sheet.columns:
            sheet = sheet.withColumnRenamed(source, target)
    absent = {c: F.lit(None).cast("string") for c in COLUMNS if c not in sheet.columns}
    if absent:
        sheet = sheet.withColumns(absent)
    return sheet.withColumns(
        {
            "date": timestamp_of(sheet, "date"),
            "amount": F.coalesce(number_of(sheet, "amount"), F.lit(0.0)),
            "cost_type": strip(F.lower(text(sheet, "cost_type"))),
        }
    )
