import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import ledgerlake as ll

BASE = dt.date(2024, 1, 1)


def plain(qb, bank, within):
    found = {}
    for row_id, company, day, amount in qb:
        near = [
            (abs((b_day - day).days), b_day, b_id)
            for b_id, b_company, b_day, b_amount in bank
            if None not in (day, amount, b_day, b_amount)
            and company == b_company
            and round(amount * 100) == round(b_amount * 100)
            and abs((b_day - day).days) <= within
        ]
        gap, b_day, b_id = min(near, default=(None, None, None))
        found[row_id] = (b_id, b_day, gap)
    return found


@pytest.mark.parametrize("within", [0, 1, 5, 40])
def test_equals_looking_at_every_pair(spark, within):
    rng = random.Random(within)

    def rows(prefix, n):
        day = lambda: None if rng.random() < 0.05 else BASE + dt.timedelta(days=rng.choice([0, 0, 0, 7, rng.randrange(400)]))
        return [(f"{prefix}{i:04d}", rng.choice(["a", "a", "a", None]), day(), rng.choice([1.0, 1.0, 1.004, 2.5, None])) for i in range(n)]

    qb, bank = rows("q", 300), rows("b", 200)
    left = spark.createDataFrame(qb, "_row_id string, company string, date date, amount double")
    right = spark.createDataFrame(bank, "bank_id string, company string, date date, amount double")
    got = ll.nearest_bank_row(left.repartition(5), right, within, by="company")
    assert got.columns == ["_row_id", "company", "date", "amount", "bank_index", "bank_date", "days_apart"]
    assert {r["_row_id"]: (r["bank_index"], r["bank_date"], r["days_apart"]) for r in got.collect()} == plain(qb, bank, within)
    assert ll.nearest_bank_row(left, right.limit(0), within, by="company").where("bank_index IS NULL").count() == 300
    assert ll.nearest_bank_row(left.limit(0), right, within).count() == 0


def test_any_key_and_times_of_day(spark):
    left = spark.sql("SELECT id, timestamp_ntz'2024-03-05 23:59:00' AS date FROM range(3)")
    right = spark.createDataFrame([(7, BASE.replace(month=3, day=4)), (6, BASE.replace(month=3, day=6))], "n int, date date")
    got = ll.nearest_rows(left, right, F.lit("k"), 3, right_id="n").distinct().select("nearest_id", "days_apart").collect()
    assert [tuple(r) for r in got] == [(7, 1)] * 3
    with pytest.raises(ValueError):
        ll.nearest_rows(left, right, F.lit("k"), -1, right_id="n")
