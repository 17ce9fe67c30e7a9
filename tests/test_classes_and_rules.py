"""Classes, addback tokens and rules, account roll-up, invoices, months, profile, display."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import ledgerlake as ll

FLAGS = ("is_revenue", "is_cogs", "is_overhead", "is_other_expense")


@pytest.mark.parametrize(
    "account_type, account, expected",
    [
        ("Income", "Sales", "Revenue"),
        ("Other Income", "Interest", "Revenue"),
        ("Expense", "Income Tax", "Revenue"),
        ("Other Expense", "Interest", "Other"),
        ("Cost of Goods Sold", "Materials", "COGS"),
        (" COGS ", "Materials", "COGS"),
        ("COGS - Labor", "Materials", "Overhead"),
        ("COGS - Labor", "705 x", "COGS"),
        ("Expense", "705.330 · FENCING", "COGS"),
        ("Expense", "7051 · FENCING", "Overhead"),
        ("Expense", "840 · Storage", "Overhead"),
        ("Expense", "\u00a0705.1 x", "COGS"),
        ("Bank Fee Expense", "Fees", "Balance Sheet"),
        ("Accounts Receivable", "Income", "Balance Sheet"),
        ("Sales Revenue", "Sales", "Balance Sheet"),
        ("", "Something", "Unclassified"),
        (None, "Something", "Unclassified"),
        ("  ", "Something", "Other"),
        ("nan", "Something", "Other"),
        ("", "Income", "Revenue"),
    ],
)
def test_class_of(spark, one, account_type, account, expected):
    rows = spark.createDataFrame([(account, account_type)], "account string, account_type string")
    got = one(ll.classify_transactions(rows))
    assert got["classification"] == expected
    assert sum(got[f] for f in FLAGS) <= 1


def test_classify_without_columns_or_prefixes(spark, one):
    assert one(ll.classify_transactions(spark.range(1)))["classification"] == "Unclassified"
    rows = spark.createDataFrame([("705 x", "Expense")], "account string, account_type string")
    assert one(ll.classify_transactions(rows, cogs_prefixes=()))["is_overhead"]


def test_prefixes(spark, one):
    rows = spark.createDataFrame([(" 7051.2 x",)], "a string")
    got = one(
        rows.select(
            ll.account_code_prefix(F.col("a")).alias("code"),
            ll.extract_account_prefix(F.col("a")).alias("full"),
            ll.account_code_prefix(F.lit("70 x")).alias("none"),
        )
    )
    assert got == {"code": "705", "full": "7051", "none": None}


def reasons(df):
    return [(r.sde_addback_flag, r.sde_addback_reason) for r in df.collect()]


def test_tokens_are_whole_words_in_order(spark):
    rows = spark.createDataFrame(
        [("Building", "ceiling"), ("NG & Owner", "xnp"), (None, None), ("C++ shop", "a.b"), ("x", "aXb")],
        "name string, memo string",
    )
    got = reasons(ll.detect_addbacks(rows, ["A.B", "", "ng"]))
    assert got == [
        (False, ""),
        (True, "token=xnp, token=ng, token=owner, token=ng"),
        (False, ""),
        (True, "token=a.b"),
        (False, ""),
    ]


def test_rules(make_ledger):
    rows = make_ledger(
        [
            ("2025-11-14", "Payroll", "Expense", "ADP", "Payroll 1", 2880.0),
            ("2025-11-15", "Payroll", "Expense", "ADP", "PAYROLL 2", -2905.0),
            ("2025-11-16", "Payroll", "Expense", "ADP", "payroll 3", 2905.01),
            ("2025-11-17", "Owner pay", "Expense", "Nathan", None, 4000.0),
        ]
    )
    rules = [
        *ll.default_rules(),
        {"name": "salary", "name_contains": "NATHAN", "amount": "-4000"},
        "skipped",
        {"name": "all"},
        {"name": "dots", "memo_contains": ["p.yroll"]},
    ]
    got = reasons(ll.detect_addbacks(rows, rules=rules))
    assert got == [
        (True, "rule=all"),
        (True, "rule=weekly_payroll_addback_2880, rule=all"),
        (True, "rule=all"),
        (True, "token=nathan, rule=salary, rule=all"),
    ]
    dotted = ll.apply_addback_rules(rows, [{"name": "dots", "memo_contains": ["p.yroll"]}], regex=True)
    assert [f for f, _ in reasons(dotted)] == [True, True, True, False]
    with pytest.raises(ValueError, match="name"):
        ll.apply_addback_rules(rows, [{"memo_contains": "x"}])


def test_rule_table_equals_rule_list(spark, make_ledger):
    rows = make_ledger(
        [
            ("2025-11-14", "Payroll", "Expense", "ADP", "Payroll 1", 2880.0),
            ("2025-11-20", "Payroll", "Expense", "Nathan", "PAYROLL 2", -2905.0),
            ("2025-11-21", "Travel", "Expense", "owner", None, None),
            ("2025-11-22", "Other", "Expense", "b", "c", 1.0),
        ]
    )
    rules = [
        *ll.default_rules(),
        ll.parse_rule({"name": "two", "account_contains": ["pay", " ROLL "], "amount": 2905}),
        ll.parse_rule({"name": "three", "name_contains": "owner", "amount": 0, "amount_tolerance": ""}),
    ]
    listed = ll.detect_addbacks(rows, rules=rules)
    table = ll.rules_table(spark, rules)
    assert reasons(ll.apply_rule_table(ll.detect_addbacks(rows), table)) == reasons(listed)

    keyed = rows.withColumn("entity", F.when(F.col("account") == "Payroll", "p").otherwise("q"))
    own = table.withColumn("entity", F.when(F.col("name") == "three", "q").otherwise("p"))
    by_entity = ll.apply_rule_table(ll.detect_addbacks(keyed), own, by="entity").orderBy("date")
    assert reasons(by_entity) == reasons(listed)
    nobody = ll.apply_rule_table(keyed, own.where("entity = 'q'"), by="entity").orderBy("date")
    assert [f for f, _ in reasons(nobody)] == [False, False, True, False]


def test_rules_round_trip(spark, tmp_path):
    rules = [
        ll.parse_rule({"name": " a ", "memo_contains": [" x ", ""], "amount": "2", "start_date": "2025-01-02"}),
        ll.parse_rule({"name": "b", "account_contains": "y"}),
    ]
    assert rules[0].name == "a" and rules[0].memo_contains == ("x",)
    ll.save_rules(spark, str(tmp_path / "rules"), rules)
    assert ll.load_rules(spark, str(tmp_path / "rules")) == rules
    listed = tmp_path / "rules.json"
    listed.write_text('[{"name": "b", "account_contains": "y"}, 5]')
    assert ll.load_rules(spark, str(listed)) == rules[1:]
    assert ll.load_rules(spark, str(tmp_path / "absent.json")) == []
    listed.write_text('{"rules": []}')
    with pytest.raises(ValueError):
        ll.load_rules(spark, str(listed))
    assert ll.rules_to_jsonable(rules)[1]["account_contains"] == ["y"]


def test_account_summary(spark):
    kinds = {"Harbor dues": "Overhead", "Fish sales": "Fish Revenue", "Nets": "Cost of Goods Sold", "Storm": "Other Expense", None: None}
    wanted = {"Harbor dues": "overhead", "Fish sales": "revenue", "Nets": "cogs", "Storm": "other", None: "other"}
    days = ["2025-02-28", "2025-03-01", "2025-04-15", "2025-05-31", "2025-06-01"]  # the first and last are outside
    data = [(day, account, kind, 100.0 * i + j) for i, day in enumerate(days) for j, (account, kind) in enumerate(kinds.items())]
    rows = spark.createDataFrame(data, "day string, account string, account_type string, amount double")
    rows = rows.withColumn("date", F.col("day").cast("date"))
    got = ll.build_account_summary(rows, "2025-03-01", "2025-05-31", {"Nets", "Storm"}).collect()
    assert {r.account: (r.classification, r.is_addback) for r in got} == {
        account: (shown, account in ("Nets", "Storm")) for account, shown in wanted.items()
    }
    assert {r.account: r.ytd_amount for r in got} == {account: 600.0 + 3 * j for j, account in enumerate(kinds)}


def test_invoices(spark):
    costs = ll.load_green_sheets(
        spark.createDataFrame(
            [
                ("Pier 6", "2025-11-04", "8000", " Material"),
                ("Pier 6", "2025-11-13", "6000", "labor"),
                ("Annex", "2025-11-18", "30000", "material"),
                ("Annex", "2025-11-18", "oops", "material"),
                ("Annex", "2025-12-01", "1", "material"),
                ("Nobody", "2025-11-18", "7", "material"),
            ],
            "Project string, Date string, Total string, `Cost Type` string",
        )
    )
    configs = [
        ll.JobBillingConfig("Pier 6", 0.20, 0.10),
        ll.JobBillingConfig("Annex", 0.20, 0.10),
        ll.JobBillingConfig("Idle", 0.20, 0.10),
        ll.JobBillingConfig("Annex", 0.0, 0.0),
    ]
    got = ll.compute_period_billing(costs, configs, "2025-11-01", dt.date(2025, 11, 30)).collect()
    rows = sorted((r.job, r.overhead_amount, r.profit_amount, r.invoice_total) for r in got)
    assert rows == [
        ("Annex", 0, 0, 30000),
        ("Annex", 6000, 3600, 39600),
        ("Idle", 0, 0, 0),
        ("Pier 6", 2800, 1680, 18480),
    ]
    assert got[0].period == "2025-11-01 → 2025-11-30"
    (alone,) = ll.compute_job_invoice(costs, configs[0], "2025-11-01", "2025-11-30").collect()
    assert (alone.materials, alone.labor, alone.supervision) == (8000, 6000, 0)


def test_half_cents_round_to_even(spark, one):
    rounded = [ll.round_half_even(F.lit(x)).alias(str(i)) for i, x in enumerate((2.675, 0.125, 0.135))]
    assert list(one(spark.range(1).select(*rounded)).values()) == [2.68, 0.12, 0.14]


def test_monthly_kpis(spark):
    """Five months of sales that double, one of them missing, against sums and shares worked out here."""
    months = {"2024-11": 800.0, "2024-12": 1600.0, "2025-01": 3200.0, "2025-03": 6400.0}
    data = []
    for month, sales in months.items():
        data += [(f"{month}-03", "Revenue", -sales * 0.75, True, False), (f"{month}-19", "Revenue", -sales * 0.25, True, None)]
        data += [(f"{month}-07", "COGS", sales / 4, False, False), (f"{month}-28", "Overhead", sales / 8, False, True)]
        data += [(f"{month}-11", "Other", 30.0, None, False), (f"{month}-12", "Other Expense", 10.0, None, None)]
    data += [("2024-10-31", "Revenue", -55.0, True, False), (None, "Overhead", 7.0, False, False)]
    rows = spark.createDataFrame(data, "day string, classification string, amount double, is_revenue boolean, sde_addback_flag boolean")
    rows = rows.withColumn("date", F.col("day").cast("timestamp_ntz"))
    monthly = ll.compute_monthly_kpis(rows, "2024-11-01")
    got = {r.month_str: r for r in monthly.collect()}
    assert list(got) == ["Oct 2024", "Nov 2024", "Dec 2024", "Jan 2025", "Mar 2025"]
    first = got.pop("Oct 2024")
    assert (first.revenue, first.net_profit, first.gross_margin_pct, first.revenue_mom_pct) == (0, 0, None, None)
    before = None
    for sales, row in zip(months.values(), got.values(), strict=True):
        net = sales * 5 / 8 - 40
        assert (row.revenue, row.cogs, row.overhead, row.other_expense) == (sales, sales / 4, sales / 8, 40)
        assert (row.net_profit, row.addbacks, row.sde) == (net, sales / 8, net + sales / 8)
        shares = dict(gross_margin_pct=0.75, net_margin_pct=net / sales, sde_margin_pct=(net + sales / 8) / sales, overhead_pct=0.125, cogs_pct=0.25)
        assert {k: row[k] for k in shares} == pytest.approx(shares)
        if before is not None:  # the month present before, also where one is missing
            assert (row.revenue_mom_delta, row.revenue_mom_pct) == (sales - before.revenue, 1)
            assert row.net_profit_mom_pct == pytest.approx(net / before.net_profit - 1)
            assert row.sde_mom_delta == row.sde - before.sde
        before = row
    assert [r.month_str for r in ll.months_from(monthly, "2025-01-15").collect()] == ["Jan 2025", "Mar 2025"]
    by_month = [(r.month_str, r.addbacks, r["count"]) for r in ll.addbacks_by_month(rows).collect()]
    assert by_month == [("Nov 2024", 100, 1), ("Dec 2024", 200, 1), ("Jan 2025", 400, 1), ("Mar 2025", 800, 1)]
    assert ll.compute_monthly_kpis(rows.limit(0), "2024-11-01").columns == monthly.columns
    with pytest.raises(ValueError):
        ll.compute_monthly_kpis(rows.drop("date"), "2024-11-01")


def test_cash_and_accrual(spark, one):
    def frame(rows, columns):
        return spark.createDataFrame(rows, columns).withColumn("date", F.col("day").cast("timestamp_ntz"))

    bank = frame([("2025-08-01", 100.0), ("2025-08-31 09:00:00", -30.0), ("2025-09-01", 5.0)], "day string, amount double")
    ledger = frame(
        [
            ("2025-08-02", "Income", -200.0),
            ("2025-08-02", "Other Income", 50.0),
            ("2025-08-02", "Expense", 40.0),
            ("2025-08-02", "Cost of Goods Sold Expense", 10.0),
            ("2025-08-02", None, 99.0),
        ],
        "day string, account_type string, amount double",
    )
    got = one(ll.compute_cash_vs_accrual_summary(ledger, bank, "2025-08-01", "2025-08-31"))
    assert (got["revenue_cash"], got["expenses_cash"], got["net_cash"]) == (100, 30, 70)
    assert (got["revenue_accrual"], got["expenses_accrual"], got["net_accrual"]) == (150, 60, 90)
    assert (got["revenue_diff"], got["expenses_diff"], got["net_diff"]) == (50, 30, 20)
    none = one(ll.compute_cash_vs_accrual_summary(ledger, bank.limit(0), "2025-08-01", "2025-08-31"))
    assert (none["revenue_cash"], none["net_diff"]) == (0, 90)


def test_profile(spark, one):
    rows = spark.createDataFrame(
        [("b", "Income", -5.0), ("a", None, 2.0), ("a", "Bank", None), ("c", "Bank", 1.0)],
        "account string, account_type string, amount double",
    ).withColumn("date", F.lit("2025-01-01").cast("date"))
    assert one(ll.non_null_counts(rows)) == {"account": 4, "account_type": 3, "amount": 3, "date": 4}
    assert [tuple(r) for r in ll.value_counts(rows, "account_type").collect()] == [("Bank", 2), ("Income", 1)]
    got = one(ll.ledger_totals(rows))
    assert (got["rows"], got["total_amount"], got["income_amount"]) == (4, -2, -5)
    assert [r.account for r in ll.distinct_accounts(rows, 2).collect()] == ["a", "b"]


def test_render_dates(spark, one):
    rows = spark.range(1).selectExpr(
        "timestamp_ntz'2025-01-02 03:04:05' as at", "timestamp_ntz'2025-01-02' as day", "date'2025-01-02' as d", "id"
    )
    assert one(ll.render_dates(rows)) == {"at": "2025-01-02 03:04:05", "day": "2025-01-02", "d": "2025-01-02", "id": 0}


def test_redact(spark):
    texts = {
        r"path C:\\Users\\me\\x.csv end": "path <REDACTED_PATH> end",
        r"on \\\\srv-1\\share\\y, z": "on <REDACTED_PATH> z",
        "see http://a.b/Upload/1 and https://c.d/e?x=1": "see <REDACTED_URL> and https://c.d/e?x=1",
        "https://q/?FILE_ID=3": "<REDACTED_URL>",
        "Widget-Id : 77, file_id=9;": "<REDACTED_ID>, <REDACTED_ID>;",
        "plain": "plain",
    }
    rows = spark.createDataFrame([(t, "pc", i) for i, t in enumerate(texts)], "note string, HostName string, n int")
    out = ll.redact_text(rows)
    assert out.columns == ["note", "n"]
    assert [r.note for r in out.orderBy("n").collect()] == list(texts.values())


def test_many_tokens_and_rules_give_what_few_give(make_ledger, monkeypatch):
    rows = make_ledger(
        [
            ("2025-11-14", "Payroll", "Expense", "Owner + co", "Payroll (1)", 2880.0),
            ("2025-11-20", "Payroll", "Expense", "Nathan", "payroll a.b", -2905.0),
            ("2025-11-21", "Travel", "Expense", "x", None, None),
        ]
    )
    tokens, rules = ["a.b", "co", "co"], [*ll.default_rules(), {"name": "all"}, {"name": "p", "memo_contains": "(1)"}]
    few = reasons(ll.detect_addbacks(rows, tokens, rules))
    monkeypatch.setattr("ledgerlake.operators.addbacks.COMPILED", 1)
    assert reasons(ll.detect_addbacks(rows, tokens, rules)) == few
    assert few[0] == (True, "token=owner, token=co, token=co, rule=all, rule=p")
    assert reasons(ll.detect_addbacks(rows, tokens, rules)) == few
    plenty = [f"word{i}" for i in range(400)]
    assert [f for f, _ in reasons(ll.detect_addbacks(rows, plenty))] == [True, True, False]


@pytest.mark.parametrize("count", [30, 31])
def test_dated_rules_behave_alike_in_short_and_long_lists(spark, count):
    rules = [ll.AddbackRule(name=f"r{i}", memo_contains=[f"word{i}"], start_date=dt.date(2025, 8, 1)) for i in range(count)]
    rows = spark.createDataFrame(
        [("2025-07-30", "word3"), ("2025-08-02", "word3 word5"), (None, "word3")], "day string, memo string"
    )
    dated = rows.selectExpr("cast(day as timestamp_ntz) as date", "memo")
    got = {(str(r.date), r.sde_addback_reason) for r in ll.apply_addback_rules(dated, rules).collect()}
    assert got == {("2025-07-30 00:00:00", ""), ("2025-08-02 00:00:00", "rule=r3, rule=r5"), ("None", "")}
    with pytest.raises(KeyError):
        ll.apply_addback_rules(rows.drop("day"), rules)
    with pytest.raises(TypeError):
        ll.apply_addback_rules(rows.withColumnRenamed("day", "date"), rules)


def plain_hits(row, rules):
    """Names of the rules that hold for (day, account, name, memo, amount), in the order of the rules."""
    day, *texts, amount = row
    texts = [(t or "").lower() for t in texts]
    found = []
    for rule in rules:
        off = 0.01 if rule.amount_tolerance is None else rule.amount_tolerance
        if rule.amount is not None and not abs(abs(amount or 0.0) - abs(rule.amount)) <= off:
            continue
        if rule.start_date is not None and (day is None or day < rule.start_date):
            continue
        wanted = (rule.account_contains, rule.name_contains, rule.memo_contains)
        if all(n.strip().lower() in t for needles, t in zip(wanted, texts, strict=True) for n in needles or ()):
            found.append(f"rule={rule.name}")
    return ", ".join(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_rule_tables_equal_trying_every_rule(spark, seed):
    import random

    rng = random.Random(seed)
    words = ["gear", "Ä", "x", "long needle here", "ge", "#00", "a.b", " rod ", "日本語テ", "needle"]
    pick = lambda: tuple(rng.choice(words) for _ in range(rng.randrange(1, 3))) if rng.random() < 0.4 else None
    rules = [
        ll.AddbackRule(
            f"r{i}", pick(), pick(), pick(),
            amount=rng.choice([None, None, 0.0, 10.0, -10.0, 10.005, 99.99, 1e15]),
            amount_tolerance=rng.choice([None, 0.0, 0.005, 5.0, 1e4, -1.0]),
            start_date=rng.choice([None, None, dt.date(2025, 8, 1)]),
        )
        for i in range(120)
    ]
    say = lambda: None if rng.random() < 0.1 else "".join(rng.choice([*words, " "]) for _ in range(rng.randrange(5)))
    rows = [
        (rng.choice([None, dt.date(2025, 7, 31), dt.date(2025, 8, 1)]), say(), say(), say(),
         rng.choice([None, 0.0, 10.0, -10.01, 10.015, 99.985, 15.0, 1e15, -1e15 - 4]))
        for _ in range(250)
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, date date, account string, name string, memo string, amount double")
    table = ll.rules_table(spark, rules)
    got = {r["i"]: r["sde_addback_reason"] for r in ll.apply_rule_table(df, table).collect()}
    assert got == {i: plain_hits(r, rules) for i, r in enumerate(rows)}
    keyed = df.withColumn("k", F.when(F.col("i") % 3 > 0, F.col("i") % 3))
    own = table.withColumn("k", F.when(F.col("pos") % 4 > 0, F.col("pos") % 4 % 3))
    got = {r["i"]: r["sde_addback_reason"] for r in ll.apply_rule_table(keyed, own, by="k").collect()}
    mine = lambda i: [r for p, r in enumerate(rules) if i % 3 and p % 4 and p % 4 % 3 == i % 3]
    assert got == {i: plain_hits(r, mine(i)) for i, r in enumerate(rows)}
    assert ll.apply_rule_table(df, table.limit(0)).where("sde_addback_flag").count() == 0


def test_many_tokens_go_by_their_order(make_ledger):
    tokens = [*(f"w{i}" for i in range(250)), "big red", "red", "c&d", "...", "été", "w3", "and-so-on", "#7"]
    rows = make_ledger(
        [
            ("2025-01-01", "", "", "W3 Big Red", "x w249", 1.0),
            ("2025-01-02", "", "", "bigred w3w", "c&d été", 1.0),
            ("2025-01-03", "", "", "big", "red a...b and-so-on", 1.0),
            ("2025-01-04", "", "", "n#7", "#7 reds", 1.0),
            ("2025-01-05", "", "", None, None, 1.0),
        ]
    )
    got = [r.sde_addback_reason for r in ll.detect_addbacks(rows, tokens).orderBy("date").collect()]
    assert got == [
        "token=w3, token=w249, token=big red, token=red, token=w3",
        "token=c&d, token=été",
        "token=red, token=..., token=and-so-on",
        "token=#7",
        "",
    ]


@pytest.mark.parametrize("seed", [3, 4])
def test_long_rule_tables_equal_short_ones(spark, seed, monkeypatch):
    """Joined by the pieces of distinct texts, rules hit what they hit when the plan holds them."""
    import random

    from ledgerlake.operators import addbacks

    rng = random.Random(seed)
    words = ["gear", "Ä", "x", "long needle here", "ge", "#000012345", "a.b", " rod ", "日本語テ", "𝄞𝄢 clefs", "needle", ""]
    pick = lambda: [rng.choice(words) for _ in range(rng.randrange(1, 3))] if rng.random() < 0.4 else None
    rules = [
        (i % 90, f"r{i}", pick(), pick(), pick(), rng.choice([None, None, 10.0]), rng.choice([None, 5.0]), rng.choice([None, "a", "b"]))
        for i in range(120)
    ]
    kinds = "pos int, name string, account_contains array<string>, name_contains array<string>, memo_contains array<string>, amount double, amount_tolerance double, k string"
    table = spark.createDataFrame(rules, kinds)
    say = lambda: None if rng.random() < 0.1 else "".join(rng.choice([*words, " "]) for _ in range(rng.randrange(5)))
    rows = [(i % 200, say(), say(), say(), rng.choice([None, 10.0, -14.0, 99.0]), rng.choice([None, "a", "b", "c"])) for i in range(250)]
    df = spark.createDataFrame(rows, "i int, account string, name string, memo string, amount double, k string")

    def results():
        return [sorted(map(str, ll.apply_rule_table(df, table, by=by, order="name").collect())) for by in ((), "k")]

    short = results()
    monkeypatch.setattr(addbacks, "HELD", 0)
    assert results() == short
    monkeypatch.setattr(addbacks, "CLASS", 1)
    assert results() == short


def test_a_long_rule_table_is_not_held_in_the_plan(spark, make_ledger):
    """Thousands of rules without an amount: neither their names nor their needles reach the driver."""
    rules = spark.range(3000).selectExpr("id as pos", "concat('rule', id) as name", "array(format_string('#%09d', id)) as name_contains")
    rows = make_ledger([("2025-08-01", "a", "", f"Customer#{i:09d}", "", 1.0) for i in (7, 2999, 3000)])
    ruled = ll.apply_rule_table(rows, rules)
    assert len(ruled._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert sorted(r["sde_addback_reason"] for r in ruled.collect()) == ["", "rule=rule2999", "rule=rule7"]
