"""The nearest row in time, for each row on its own: no row is used up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, keys, named
from .matching import _group_key


def nearest_rows(
    left: DataFrame,
    right: DataFrame,
    key: Column,
    within: int,
    *,
    right_id: str,
    date: str = "date",
    names: tuple[str, str, str] = ("nearest_id", "nearest_date", "days_apart"),
) -> DataFrame:
    """Left rows with id and date of the nearest right row of an equal ``key``, at most ``within`` days away.

    Of equally near rows the earlier day wins, then the smaller id; rows without key or date, and those with
    nothing near, get nulls. Either side may repeat keys and days as often as it likes.

    Both sides are reduced to one cell for each key and day before anything is sorted: of the right side, the
    smallest id. Cells are stacked, and the last and the next right cell of each left one is read off by a
    window. Time is cut into slabs of twice the reach; a right cell goes to the one or two slabs that it can
    reach, so no key, however many days it has, is sorted as a whole, and no slab has to look at another.
    """
    if within < 0:
        raise ValueError("within must not be negative")
    slab = 2 * within + 1
    day = F.unix_date(F.to_date(named(date))).cast("bigint")
    has = F.col("_k").isNotNull() & F.col("_day").isNotNull()
    mine = left.withColumns({"_k": key, "_day": day})
    wanted = mine.where(has).select("_k", "_day").distinct()
    theirs = right.select(key.alias("_k"), day.alias("_day"), named(right_id).alias("_id")).where(has)
    cells = theirs.groupBy("_k", "_day").agg(F.min("_id").alias("_id"))

    reached = F.sequence(F.floor((F.col("_day") - within) / slab), F.floor((F.col("_day") + within) / slab))
    none = F.lit(None).cast(right.schema[right_id].dataType)
    stacked = wanted.select("_k", F.floor(F.col("_day") / slab).alias("_slab"), "_day", F.lit(True).alias("_asks"), none.alias("_id"))
    stacked = stacked.unionByName(
        cells.select("_k", F.explode(reached).alias("_slab"), "_day", F.lit(False).alias("_asks"), "_id")
    )
    there = F.when(~F.col("_asks"), F.struct("_day", "_id"))
    line = Window.partitionBy("_k", "_slab").orderBy("_day", "_asks")
    before = F.last(there, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(there, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    asked = stacked.withColumns({"_before": before, "_after": after}).where("_asks")
    gap = lambda cell: F.abs(F.col(f"{cell}._day") - F.col("_day"))
    nearer = F.when(
        F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")
    ).otherwise(F.col("_after"))
    found = asked.select("_k", "_day", nearer.alias("_best")).where(F.abs(F.col("_best._day") - F.col("_day")) <= within)
    answered = mine.join(found, ["_k", "_day"], "left")
    return answered.select(
        *map(named, left.columns),
        F.col("_best._id").alias(names[0]),
        F.date_from_unix_date(F.col("_best._day").cast("int")).alias(names[1]),
        F.abs(F.col("_best._day") - F.col("_day")).alias(names[2]),
    )


def nearest_bank_row(
    qb: DataFrame, bank: DataFrame, date_tolerance_days: int = 14, *, by: str | Sequence[str] = (), bank_id: str = "bank_id"
) -> DataFrame:
    """Ledger rows with the nearest bank row of the same amount to the cent: ``bank_index``, ``bank_date``, ``days_apart``.

    Unlike a match, several ledger rows may have the same nearest bank row.
    """
    cents = F.rint(as_double() * 100).try_cast("bigint")
    key = F.when(cents.isNotNull(), _group_key(keys(by), cents.alias("_cents")))
    names = ("bank_index", "bank_date", "days_apart")
    return nearest_rows(qb, bank, key, date_tolerance_days, right_id=bank_id, names=names)
