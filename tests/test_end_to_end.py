"""From export files to the dashboard record."""

import json

import ledgerlake as ll

LEDGER = """Acme Builders,,,,,,
Date,Account,Account Type,Name,Memo,Debit,Credit
07/20/2025,865 · Rent,Expense,Landlord,July rent,700.00,
08/01/2025,Sales,Income,Customer,Inv 1,,"5,000.00"
08/15/2025,705.120 · Lumber,Expense,Yard,Lumber,"1,500.00",
09/02/2025,600 · Pay,Expense,Nathan,Draw,400.00,
11/20/2025,600 · Pay,Expense,ADP,Weekly payroll,"2,880.00",
11/21/2025,Checking,Bank,ADP,Transfer,,"2,880.00"
,Total,,,,"5,480.00",
"""


def test_ledger_file_to_payload(spark, tmp_path, one):
    (tmp_path / "acme.csv").write_text(LEDGER, encoding="utf-8")
    ledger = ll.load_ledger(spark, str(tmp_path / "acme.csv"))
    rows = ll.flagged_ledger(ledger)
    dates = ("2025-08-01", "2025-12-31", "2026-06-30")
    metrics = ll.dashboard_metrics(rows, *dates, selected_row_ids=["0"])
    got = one(metrics)
    assert (got["revenue"], got["cogs"], got["overhead"], got["other_expense"]) == (5000, 1500, 3280, 0)
    assert (got["net_profit"], got["addbacks"], got["sde"]) == (220, 3280, 3500)
    assert (got["legacy_overhead_included"], got["adjusted_net_profit"], got["adjusted_sde"]) == (700, -480, 2800)
    payload = one(ll.dashboard_payload(metrics, *dates).selectExpr("to_json(payload) as text"))
    record = json.loads(payload["text"])
    assert record["dashboard_metrics"]["ytd_net"] == -480
    assert record["run_rates"]["monthly_revenue"] == 5000 / 152 * 30.4375
    assert record["config"]["july_overhead_window"] == {"start": "2025-07-01", "end": "2025-07-31"}
    assert record["config"]["july_overhead_selected_count"] == 1
    months = ll.dashboard_months(rows, *dates[:2]).collect()
    assert [(m.month_str, m.net_profit, m.sde) for m in months] == [
        ("Aug 2025", 3500, 3500),
        ("Sep 2025", -400, 0),
        ("Nov 2025", -2880, 0),
    ]
    monthly_total = sum(m.net_profit for m in months)
    assert monthly_total == got["net_profit"]


def test_monthly_lines_add_up_to_the_period(spark, one):
    """On the test tables: months of one sign sum to the period's figures."""
    from registry.core import ledger

    rows = ll.detect_addbacks(ll.classify_transactions(ledger(spark, "/root/testdata/sf0.001")), ["ring"])
    period = one(ll.get_period_metrics(rows))
    months = ll.compute_monthly_kpis(rows, "1990-01-01").collect()
    for measure in ("revenue", "cogs", "overhead", "other_expense", "net_profit"):
        assert abs(sum(m[measure] for m in months) - period[measure]) < 0.01
    flags = rows.selectExpr(
        "max(int(is_revenue) + int(is_cogs) + int(is_overhead) + int(is_other_expense)) as most"
    )
    assert one(flags)["most"] == 1
