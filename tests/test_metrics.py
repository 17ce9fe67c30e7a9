"""Period metrics on small ledgers with known answers."""

import random

import pytest
from pyspark.sql import functions as F

import ledgerlake as ll

KINDS = ("Income", "Cost of Goods Sold", "Expense", "Other Expense", "Equity")
FIGURES = {"Income": "revenue", "Cost of Goods Sold": "cogs", "Expense": "overhead", "Other Expense": "other_expense"}


def random_rows(seed, sign=1, n=60):
    """Rows of all kinds on days of four months, some for the owner, some on a job's account."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = rng.choice(KINDS)
        account = rng.choice(["7051 Piers", "706 Piles", "Quay dues", "Lamps", "812 Freight"])
        size = rng.randrange(1, 400) * 25.0
        credit = kind == "Income"
        who = rng.choice(["Brisk & Co", "Nathan", "Wharf Nine"])
        day = f"2025-{rng.randrange(6, 10):02d}-{rng.randrange(1, 29):02d}"
        rows.append((day, account, kind, who, rng.choice(["", "spare xnp", "rope"]), sign * (-size if credit else size)))
    return rows


def plain_owner(rows, start, end, cut_over, overrides=(), job=("704", "705", "706", "707", "708")):
    """The owner metrics, summed row by row."""
    out = dict.fromkeys(ll_owner_measures(), 0.0)
    plus = minus = 0.0
    for day, account, kind, name, memo, amount in rows:
        if not start <= day <= end or kind == "Equity":
            figure = None
        else:
            figure = FIGURES[kind]
        if start <= day <= end and (name == "Nathan" or "xnp" in memo or account in overrides):
            plus, minus = plus + max(amount, 0), minus + max(-amount, 0)
        if figure is None:
            continue
        if account.split()[0] in job and figure == "overhead":
            figure = "cogs"
        if day >= cut_over:
            out[figure] += amount
        elif figure != "revenue":
            out["legacy_july_total_expense"] += amount
            if account[:3] in job:
                out["legacy_july_excluded_job_cost"] += amount
            if figure == "cogs":
                out["legacy_cogs"] += amount
            elif figure == "overhead" and account[:3] not in job:
                out["legacy_july_included_overhead"] += amount
    out = {k: abs(v) for k, v in out.items()} | {"addbacks": plus or minus}
    out["gross_profit"] = out["revenue"] - out["cogs"]
    out["net_profit"] = out["gross_profit"] - out["overhead"] - out["other_expense"]
    out["sde"] = out["net_profit"] + out["addbacks"]
    return out


def ll_owner_measures():
    from ledgerlake.operators.metrics import OWNER_MEASURES

    return OWNER_MEASURES


CUT_OVER = "2025-08-01"


def flagged(ledger):
    return ll.detect_addbacks(ll.classify_transactions(ledger))


def subset(row, expected):
    return {k: row[k] for k in expected} == expected


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("sign", [1, -1])
def test_owner_metrics_equal_summing_row_by_row(make_ledger, one, seed, sign):
    data = random_rows(seed, sign)
    rows = flagged(make_ledger(data))
    for overrides in (set(), {"Lamps", "812 Freight"}):
        got = one(ll.get_owner_metrics(rows, "2025-06-05", "2025-09-20", CUT_OVER, addback_account_overrides=overrides))
        assert got == plain_owner(data, "2025-06-05", "2025-09-20", CUT_OVER, overrides)


def test_preclassified_rows_without_account_or_flag(spark, one):
    rows = spark.createDataFrame(
        [
            ("2025-07-09", 91000.0, True, False, False),
            ("2025-08-12", 164000.0, True, False, False),
            ("2025-08-14", -430000.0, False, True, False),
            ("2025-07-18", 37000.0, False, False, True),
        ],
        "day string, amount double, is_cogs boolean, is_revenue boolean, is_overhead boolean",
    ).selectExpr("cast(day as timestamp_ntz) as date", "*", "false as is_other_expense")
    got = one(ll.get_owner_metrics(rows, "2025-07-01", "2025-12-31", CUT_OVER))
    assert subset(
        got,
        dict(revenue=430000, cogs=164000, legacy_cogs=91000, overhead=0,
             legacy_july_included_overhead=37000, net_profit=266000),
    )


def test_job_cost_prefix_before_cut_over(make_ledger, one):
    rows = flagged(
        make_ledger(
            [
                ("2025-07-08", "705.260 · DECK", "Expense", "Rail Co", "early job cost", 930.0),
                ("2025-07-14", "Storage", "Expense", "Depot 4", "july unit", 410.0),
                ("2025-07-16", "Loan Cost", "Other Expense", "Credit Union", "july loan", 90.0),
                ("2025-08-06", "Contract Sales", "Income", "Mill Street LLC", "stage", -3600.0),
                ("2025-08-08", "705.260 · DECK", "Expense", "Rail Co", "later job cost", 520.0),
                ("2025-08-12", "Storage", "Expense", "Depot 4", "august unit", 380.0),
                ("2025-08-21", "Loan Cost", "Other Expense", "Credit Union", "august loan", 60.0),
            ]
        )
    )
    got = one(
        ll.get_owner_metrics(
            rows, "2025-07-01", "2025-08-31", CUT_OVER, legacy_job_cost_prefixes={"705"}
        )
    )
    assert subset(
        got,
        dict(legacy_july_excluded_job_cost=930, legacy_july_included_overhead=410, other_expense=60,
             cogs=520, overhead=380, revenue=3600, net_profit=2640),
    )


def test_run_rates_and_forecast_follow_from_the_period(make_ledger, one):
    data = random_rows(8, -1)
    rows = flagged(make_ledger(data))
    owner = ll.get_owner_metrics(rows, "2025-06-01", "2025-09-28", CUT_OVER)
    period = ll.get_period_metrics(ll.report_window(rows, CUT_OVER, "2025-09-28"))
    expected = plain_owner(data, CUT_OVER, "2025-09-28", CUT_OVER)
    assert one(period) == {k: expected[k] for k in one(period)}
    rates = ll.calculate_run_rates(period, 59)
    outlook, sofar = one(ll.forecast_year_1(owner, rates, 250)), one(owner)
    for measure in ("revenue", "sde"):
        assert one(rates)[measure] == pytest.approx(expected[measure] / 59 * 30.4375)
        assert outlook[measure] == pytest.approx(sofar[measure] + expected[measure] / 59 * 250)
    assert outlook["months_remaining"] == pytest.approx(250 / 30.4375)


def test_run_rate_without_days_is_zero_and_negative_days_forecast_nothing(spark, one):
    metrics = spark.range(1).selectExpr("10D as revenue", "4D as cogs", "6D as gross_profit")
    assert one(ll.calculate_run_rates(metrics, 0)) == dict(revenue=0, cogs=0, gross_profit=0)
    assert one(ll.forecast_year_1(metrics, metrics, -3))["revenue"] == 10


def test_dashboard_projection_figures(spark, one):
    """A published year-to-date and its projections. All figures."""
    metrics = spark.range(1).selectExpr(
        "5676943.95D as revenue", "3439867.52D as cogs", "742324.28D as overhead",
        "1494752.1500000004D as net_profit", "1586143.5600000003D as sde",
    )
    rates = ll.calculate_run_rates(metrics, 153)
    got = one(rates)
    assert got["revenue"] == pytest.approx(1129359.3560661764)
    assert got["net_profit"] == pytest.approx(297362.86644199357)
    assert got["sde"] == pytest.approx(315544.08240196086)
    outlook = one(ll.forecast_year_1(metrics, rates, 180))
    assert outlook["net_profit"] == pytest.approx(3253284.0911764717)
    assert outlook["sde"] == pytest.approx(3452194.807058824)


def test_legacy_selection_by_account_and_row(make_ledger, one):
    rows = ll.classify_transactions(
        make_ledger(
            [
                ("2025-07-08", "840 · Storage", "Expense", "Depot 4", "unit one", 62.0),
                ("2025-07-17", "840 · Storage", "Expense", "Depot 4", "unit two", 31.0),
                ("2025-07-23", "910 · Sundries", "Expense", "Shop 3", "tape", 14.0),
                ("2025-07-29", "Loan Cost", "Other Expense", "Credit Union", "july loan", 88.0),
                ("2025-08-01", "840 · Storage", "Expense", "Depot 4", "august", 141.0),
            ]
        )
    ).withColumn("_row_id", F.col("amount").cast("string"))
    window = ("2025-07-01", "2025-07-31")

    def total(**options):
        return one(ll.compute_legacy_overhead_addins(rows, *window, **options))["legacy_overhead"]

    assert total(included_accounts={"840 · Storage"}) == 93
    assert total() == 107 == total(included_accounts=set(), included_row_ids=set())
    assert total(included_row_ids={"31.0", "141.0"}) == 31
    assert total(included_row_ids=rows.where("amount < 40").select("_row_id")) == 45
    assert one(ll.compute_legacy_overhead_addins(rows.drop("is_overhead"), *window))["legacy_overhead"] == 0
    assert one(ll.compute_legacy_overhead_addins(rows.limit(0), *window))["legacy_overhead"] == 0
    shown = ll.legacy_overhead_candidates(rows, CUT_OVER).collect()
    assert [r.amount for r in shown] == [62, 31, 14]


def test_addin_adjusts_overhead_net_and_sde(spark, one):
    base = spark.range(1).selectExpr(
        "1000D as revenue", "100D as cogs", "200D as overhead", "50D as other_expense",
        "10D as addbacks", "900D as gross_profit", "650D as net_profit", "660D as sde",
    )
    got = one(ll.apply_legacy_overhead_addins(base, 75.0))
    assert subset(got, dict(overhead=275, net_profit=575, sde=585, legacy_overhead_included=75))
    assert subset(one(ll.apply_legacy_overhead_addins(base)), dict(net_profit=650, legacy_overhead_included=0))
    table = spark.range(1).selectExpr("75D as legacy_overhead")
    adjusted = ll.apply_legacy_overhead_addins(base.withColumn("qb_net_profit", F.col("net_profit")), table)
    bridge = ll.reconciliation_bridge(adjusted, ["Net", "Less", "Adjusted"]).collect()
    assert [(r.step, r.amount) for r in bridge] == [("Net", 650), ("Less", -75), ("Adjusted", 575)]


def detail(spark):
    return spark.createDataFrame(
        [
            ("2025-07-12", "Yard Nine", "early beams", "520 - Timber", 930.0, "Cost of Goods Sold"),
            ("2025-07-24", "Depot 4", "july unit", "640 - Storage", 1700.0, "Expense"),
            ("2025-08-07", "Mill Street LLC", "phase two", "410 - Contracts", -5200.0, "Income"),
            ("2025-08-14", "Yard Nine", "later beams", "520 - Timber", 760.0, "Cost of Goods Sold"),
            ("2025-08-22", "Telco", "lines", "650 - Phones", 240.0, "Expense"),
            ("2025-09-03", "Ferry Line", "phase three", "410 - Contracts", -2900.0, "Income"),
        ],
        "day string, name string, memo string, account string, amount double, account_type string",
    ).withColumn("date", F.col("day").cast("timestamp_ntz"))


def test_period_kpis_keep_july_overhead(spark, one):
    got = one(ll.compute_period_kpis(detail(spark), "2025-07-01", "2025-09-30", CUT_OVER))
    assert subset(
        got, dict(cogs=760, legacy_cogs=930, overhead=1940, revenue=8100, net_profit=5400, gross_profit=7340)
    )
    later = one(ll.compute_period_kpis(detail(spark), CUT_OVER, "2025-09-30"))
    assert subset(later, dict(cogs=760, legacy_cogs=0, overhead=240, revenue=8100))
    empty = one(ll.compute_period_kpis(detail(spark), "2030-01-01", "2030-02-01"))
    assert set(empty.values()) == {0.0}


def test_kpi_report_equals_the_separate_periods(spark, one):
    record = one(ll.kpi_report(detail(spark), "2025-09-30", source_file="detail.csv"))
    assert record["owner_period"].asDict() == one(
        ll.compute_period_kpis(detail(spark), "2025-07-01", "2025-09-30", CUT_OVER)
    )
    assert record["run_rate_period"].asDict() == one(
        ll.compute_period_kpis(detail(spark), CUT_OVER, "2025-09-30", CUT_OVER)
    )
    assert record["metadata"]["source_file"] == "detail.csv"
    assert record["summary"]["owner_period_days"] == 91
    assert record["summary"]["run_rate_period_days"] == 60
    assert record["summary"]["july_legacy_cogs_excluded"] == 930
    rows = {r.period: r.revenue for r in ll.kpi_periods(detail(spark), "2025-09-30").collect()}
    assert rows == {"owner_period": 8100, "run_rate_period": 8100}


def test_windows_include_the_last_day_by_date_but_not_by_midnight(spark, one):
    rows = spark.createDataFrame(
        [("2025-08-31 10:00:00", "A", "Expense", 5.0), ("2025-08-31 00:00:00", "A", "Expense", 7.0)],
        "at string, account string, account_type string, amount double",
    ).withColumn("date", F.col("at").cast("timestamp_ntz"))
    classified = ll.detect_addbacks(ll.classify_transactions(rows))
    assert one(ll.get_owner_metrics(classified, CUT_OVER, "2025-08-31", CUT_OVER))["overhead"] == 12
    assert one(ll.build_account_summary(rows, CUT_OVER, "2025-08-31"))["ytd_amount"] == 7


def test_addback_size_prefers_positive_rows(spark, one):
    def size(*amounts):
        rows = spark.createDataFrame([(a, True) for a in amounts], "amount double, sde_addback_flag boolean")
        return one(ll.get_period_metrics(rows))["addbacks"]

    assert size(5.0, -3.0, 2.0, None) == 7
    assert size(-5.0, -3.0, 0.0) == 8
    assert size(float("nan"), -1.0) == 1
    assert size(0.0) == 0


def test_metrics_by_entity_equal_metrics_of_each_entity(make_ledger, one):
    both = make_ledger(random_rows(21)).withColumn("entity", F.lit("a")).union(
        make_ledger(random_rows(22, -1)).withColumn("entity", F.lit("b"))
    )
    rows = flagged(both)
    window = ("2025-06-03", "2025-12-01", CUT_OVER)
    together = {r.entity: r.asDict() for r in ll.get_owner_metrics(rows, *window, by="entity").collect()}
    for entity, got in together.items():
        alone = one(ll.get_owner_metrics(rows.where(F.col("entity") == entity), *window))
        assert {k: v for k, v in got.items() if k != "entity"} == alone


def test_financial_analysis_equals_its_parts(make_ledger, one):
    rows = make_ledger(random_rows(22, -1))
    got = one(ll.financial_analysis(rows, "2025-09-30", CUT_OVER, "2026-06-30"))
    owner = ll.get_owner_metrics(flagged(rows), None, "2025-09-30", CUT_OVER)
    rates = ll.calculate_run_rates(
        ll.get_period_metrics(flagged(rows).where("date >= '2025-08-01'")), 60
    )
    outlook = one(ll.forecast_year_1(owner, rates, 273))
    assert str(got["owner_period_start"]) == min(r[0] for r in random_rows(22, -1))
    for measure, value in one(owner).items():
        assert got[measure] == value
    for measure, value in one(rates).items():
        assert got[f"monthly_{measure}"] == pytest.approx(value)
    for measure, value in outlook.items():
        if measure != "months_remaining":
            assert got[f"proj_{measure}"] == pytest.approx(value)


def test_dashboard_equals_its_parts(make_ledger, one, tmp_path):
    ledger = make_ledger(random_rows(21)).withColumn("_row_id", F.concat_ws("/", F.col("date").cast("string"), "account", F.col("amount").cast("string")))
    extra = make_ledger([("2025-07-20", "Rent", "Expense", "Landlord", "July", 700.0)])
    ledger = ledger.union(extra.withColumn("_row_id", F.lit("july")))
    rows = ll.flagged_ledger(ledger)
    got = one(ll.dashboard_metrics(rows, CUT_OVER, "2025-09-30", "2026-06-30", ["july", "2025-08-02/Lamps/1.0"]))
    plain = one(ll.dashboard_metrics(rows, CUT_OVER, "2025-09-30", "2026-06-30"))
    period = ll.get_period_metrics(ll.report_window(rows, CUT_OVER, "2025-09-30"))
    for measure, value in one(period).items():
        assert got[measure] == plain[measure] == value
    assert (got["legacy_overhead_included"], got["legacy_overhead_rows"]) == (700, 1)
    assert (plain["legacy_overhead_included"], plain["adjusted_net_profit"]) == (0, plain["net_profit"])
    adjusted = ll.apply_legacy_overhead_addins(period, 700.0).drop("legacy_overhead_included")
    outlook = one(ll.forecast_year_1(adjusted, ll.calculate_run_rates(period, 60), 273))
    for measure in ("revenue", "overhead", "gross_profit", "net_profit", "sde"):
        assert got[f"proj_{measure}"] == pytest.approx(outlook[measure])
    metrics = ll.dashboard_metrics(rows, CUT_OVER, "2025-09-30", "2026-06-30", ["july"])
    payload = ll.dashboard_payload(metrics, CUT_OVER, "2025-09-30", "2026-06-30")
    ll.write_json(payload, str(tmp_path / "payload"))
    back = one(payload.sparkSession.read.json(str(tmp_path / "payload")))["payload"]
    assert back["config"]["july_overhead_window"]["end"] == "2025-07-31"
    assert back["reconciliation_bridge"]["adjusted_net"] == got["adjusted_net_profit"]


def test_decimal_amounts_are_summed_exactly(spark, make_ledger, one):
    cents = [("2025-08-05", "Rent", "Expense", "Owner", "m", 0.1)] * 30 + [
        ("2025-08-06", "Sales", "Income", "c", "m", -1e15),
        ("2025-08-07", "Sales", "Income", "c", "m", 1e15),
    ]
    exact = flagged(make_ledger(cents).withColumn("amount", F.col("amount").cast("decimal(18,2)")))
    metrics = ll.get_owner_metrics(exact, "2025-08-01", "2025-08-31", CUT_OVER)
    assert subset(one(metrics), dict(overhead=3.0, addbacks=3.0, revenue=0.0, net_profit=-3.0))
    assert metrics.schema["overhead"].dataType.simpleString() == "double"
    (month,) = ll.compute_monthly_kpis(exact, CUT_OVER).collect()
    assert (month.overhead, month.addbacks, month.revenue) == (3.0, 3.0, 0.0)
    assert one(ll.get_period_metrics(exact))["sde"] == 0.0
    assert one(ll.ledger_totals(exact))["total_amount"] == 3.0
    bank = exact.withColumn("bank_id", F.col("memo")).limit(1)
    matched, summary = ll.reconcile_transactions(bank, exact.withColumn("_row_id", F.col("name")).limit(1))
    assert one(summary)["total_matched"] == matched.matched.count() == 1


def test_rows_without_a_key_keep_their_own_rates_and_addins(spark):
    rows = [("a", 100.0, 5.0), (None, 100.0, 5.0)]
    metrics = spark.createDataFrame(rows, "entity string, revenue double, overhead double").selectExpr(
        "*", "0D as cogs", "0D as other_expense", "0D as addbacks", "0D as gross_profit"
    )
    outlook = ll.forecast_year_1(metrics, ll.calculate_run_rates(metrics, 30, by="entity"), 30, by="entity")
    assert sorted((r.entity or "", r.revenue) for r in outlook.collect()) == [("", 200.0), ("a", 200.0)]
    addin = spark.createDataFrame([("a", 10.0), (None, 10.0)], "entity string, legacy_overhead double")
    adjusted = ll.apply_legacy_overhead_addins(metrics, addin, by="entity")
    assert sorted((r.entity or "", r.overhead) for r in adjusted.collect()) == [("", 15.0), ("a", 15.0)]
