"""Loading of messy exports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import ledgerlake as ll
from ledgerlake.sources.layout import discover_layout


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("_pos").select(*columns).collect()]


MESSY = """Acme Ltd
"Transactions, all",,,
01/05/2025,sample,above the header,1
,Date ,ACCOUNT,Account Type,Name,Memo,Amount,Unnamed: 7,Memo
x,01/15/2025,Sales,Income,Cust,"a, ""quoted"" memo","-1,000.50",,second
,2025-02-01 10:30:00,Rent,Expense,Landlord,"two
lines",$500,,
Total,,,,,,12
,01/16/2025,too,many,cells,in,1,this,row,really
,03/04/25,Short
,2025/3/5,Fees,Expense,None,N/A,(100),,

,bad date,Fees,Expense,n,m,1,,
"""


def test_ledger_with_title_rows(spark, tmp_path):
    path = write(tmp_path / "ledger.csv", MESSY)
    df = ll.load_ledger(spark, path)
    assert df.columns[:6] == ["date", "account", "account_type", "name", "memo", "amount"]
    assert rows(df, "_row_id", "date", "account", "name", "memo", "amount") == [
        ("0", dt.datetime(2025, 1, 15), "Sales", "Cust", 'a, "quoted" memo', -1000.5),
        ("1", dt.datetime(2025, 2, 1), "Rent", "Landlord", "two\nlines", 500.0),
        ("2", dt.datetime(2025, 3, 4), "Short", None, None, 0.0),
        ("3", dt.datetime(2025, 3, 5), "Fees", None, None, 0.0),
    ]
    layout = discover_layout(spark, path, ("date", "account"))
    assert layout.skip_rows == 4 and not layout.header_on_top


def test_dated_row_above_the_header_is_dropped_by_place(spark, tmp_path):
    text = "Txn,Sample\n01/05/2025,above\nDate,Account,Debit,Credit\n01/05/2025,above\n01/06/2025,b,7,\n01/07/2025,c,,2\n"
    path = write(tmp_path / "l.csv", text)
    assert discover_layout(spark, path, ("date", "account")).skip_rows == 3
    for multiline in (True, False):
        df = ll.load_ledger(spark, path, multiline=multiline)
        assert rows(df, "account", "amount", "memo") == [("above", 0, ""), ("b", 7, ""), ("c", -2, "")]


def test_one_sided_and_missing_columns(spark, tmp_path):
    only_debit = write(tmp_path / "d.csv", "Date,Account,Debit\n1/2/2025,a,$5\n")
    assert rows(ll.load_ledger(spark, only_debit), "amount", "account_type", "name") == [(5, "", "")]
    other_date = write(tmp_path / "p.csv", "Posting Date,Account,Amount\n1/2/2025,a,5\n,b,6\n")
    assert rows(ll.load_ledger(spark, other_date), "account", "amount") == [("a", 5)]
    undated = write(tmp_path / "u.csv", "Account,Amount\na,5\n")
    assert ll.load_ledger(spark, undated).count() == 0
    with pytest.raises(ValueError, match="Unsupported"):
        ll.load_ledger(spark, write(tmp_path / "x.xlsx", "x"))


def test_files_with_different_layouts_and_encodings(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", "Date,Account,Memo,Amount\n1/2/2025,Café,“q”,1\n1/3/2025,b,,2\n", "cp1252")
    write(folder / "b.csv", "﻿Amount,Date,Account\n3,1/4/2025,Zürich · 1\n", "utf-8")
    write(folder / "c.csv", "Date,Account,Memo,Amount\n1/5/2025,d,plain,4\n", "utf-8")
    df = ll.load_ledger(spark, str(folder))
    assert rows(df, "_row_id", "account", "memo", "amount") == [
        ("0", "Café", "“q”", 1),
        ("1", "b", None, 2),
        ("2", "Zürich · 1", None, 3),
        ("3", "d", "plain", 4),
    ]
    loose = ll.load_ledger(spark, str(folder), dense_ids=False)
    together = {r["_row_id"] for r in loose.collect()}
    alone = [ll.load_ledger(spark, str(folder / f), dense_ids=False) for f in ("a.csv", "b.csv", "c.csv")]
    assert len(together) == 4 and together == {r["_row_id"] for df in alone for r in df.collect()}
    assert "_pos" not in loose.columns
    same = [str(folder / "a.csv"), str(folder / "c.csv")]
    assert ll.load_ledger(spark, same, same_layout=True).count() == 3


def test_dense_ids_over_many_splits(spark, tmp_path):
    lines = "".join(f"{i % 12 + 1}/{i % 28 + 1}/2025,acc {i},{i}\n" for i in range(5000))
    path = write(tmp_path / "big.csv", "Date,Account,Amount\n" + lines)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        df = ll.load_ledger(spark, path, multiline=False)
        assert df.select(F.spark_partition_id()).distinct().count() > 1
        got = rows(df, "_row_id", "amount")
    finally:
        spark.conf.set(key, before)
    assert got == [(str(i), float(i)) for i in range(5000)]


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["Txn Date", "Unnamed: 1", " memo", "MEMO", "nan"])
    assert ll.normalize_ledger_columns(df).columns == ["txn_date", "memo"]


# Fixed value: the export's header line. The rows are made up.
DETAIL = ""","Type","Date","Num","Name","Memo","Account","Class","Debit","Credit","Amount","Account Type"
"Third quarter",,,,,,,,,,,
,"Check","09/12/25",,"Kite Shop","kites","640 - Stock","","",55.00,55.00,"Expense"
,"Bill","08/02/25",,"Loom House","cloth","530 - Cloth","",210.00,"",210.00,"Cost of Goods Sold"
,"Journal","07/19/25","12","","july wages","660 - Wages","",320.00,"",320.00,"Expense"
,"Invoice","08/30/25",,"Ann & Sons","sails","400 - Sails",,"",990.00,-990.00,"Income"
,"Bill","07/05/25",,"Loom House","thread","530 - Cloth","",80.00,"",80.00,"Cost of Goods Sold"
,"Invoice","09/02/25",,"Ann & Sons","flags","400 - Sails",,"",110.00,-110.00,"Income"
"""


def test_transaction_detail(spark, tmp_path, one):
    df = ll.load_transaction_detail(spark, write(tmp_path / "d.csv", DETAIL))
    assert df.count() == 6 and {"date", "class", "account_type", "num"} <= set(df.columns)
    got = one(ll.compute_period_kpis(df, "2025-07-01", "2025-08-31", "2025-08-01"))
    assert (got["revenue"], got["cogs"], got["legacy_cogs"], got["overhead"]) == (990, 210, 80, 320)
    minimal = "Type,Date,Name,Memo,Account,Class,Amount,Account Type\nInvoice,12/08/2025,Oak Hall,bill nine,4100 Fees,,340.00,Income\n"
    (row,) = ll.load_transaction_detail(spark, write(tmp_path / "m.csv", minimal)).collect()
    assert (row.date, row["class"], row.amount) == (dt.datetime(2025, 12, 8), "", 340)
    with pytest.raises(ValueError, match="amount"):
        ll.load_transaction_detail(spark, write(tmp_path / "n.csv", "Type,Date\nBill,1/1/2025\n"))


BANK = """Transaction Date,Transaction Description,Amount
08/01/2025,Check 1,- $28800.3
08/02/2025,Deposit,"+ $1,200.00"
08/03/2025,Fee,(12.30)
bad,Other,5
08/04/2025,Void,abc
"""


def test_bank_export_and_register(spark, tmp_path):
    raw = ll.load_bank_export(spark, write(tmp_path / "b.csv", BANK))
    got = [(r.transaction_description, r.amount, r.date is None) for r in raw.collect()]
    assert got == [("Check 1", -28800.3, False), ("Deposit", 1200, False), ("Fee", -12.3, False), ("Other", 5, True), ("Void", 0, False)]
    text = spark.read.csv(str(tmp_path / "b.csv"), header=True)
    register = ll.normalize_bank_register(text).collect()
    assert [(r.description, r.amount, r.source) for r in register] == [("Check 1", -28800.3, "bank"), ("Deposit", 1200, "bank"), ("Fee", -12.3, "bank")]
    with pytest.raises(ValueError, match="date"):
        ll.normalize_bank_register(text.drop("Transaction Date"))
    with pytest.raises(ValueError, match="amount"):
        ll.normalize_bank_register(text.drop("Amount"))


def test_ledger_side_of_a_reconciliation(spark):
    df = spark.createDataFrame(
        [("1/2/2025", "5", "N", "M"), ("1/2/2025", "5", None, "| M "), ("1/2/2025", "x", "N", "M"), ("?", "5", "N", "M")],
        "date string, amount string, name string, memo string",
    )
    got = ll.normalize_qb_ledger_for_bank(df).collect()
    assert [(r.description, r.account, r.source) for r in got] == [("N | M", "", "qb"), ("M", "", "qb")]
    with pytest.raises(ValueError):
        ll.normalize_qb_ledger_for_bank(df.drop("amount"))


def test_bank_account_filter(spark, tmp_path):
    path = write(tmp_path / "l.csv", "Date,Account,Amount\n1/2/2025,My pnc Checking,5\n1/2/2025,Other,6\n")
    assert [r.amount for r in ll.load_qb_export(spark, path).collect()] == [5]
    assert [r.amount for r in ll.load_qb_export(spark, path, "oth").collect()] == [6]


def test_green_sheets_rename_only_into_absent_names(spark):
    df = spark.createDataFrame([("p", "j", "5", "n")], "Project string, Job string, Total string, Name string")
    sheet = ll.load_green_sheets(df)
    (row,) = sheet.collect()
    assert (row.project, row.job, row.amount, row.vendor_or_employee, row.cost_type) == ("p", "j", 5, "n", "")
    assert row.date is None and row.ref is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("08/01/25", "2025-08-01 00:00:00"),
        ("8/5/2025 10:30", "2025-08-05 00:00:00"),
        ("2025-08-05T10:30:00", "2025-08-05 00:00:00"),
        ("2025/8/5 9:00", "2025-08-05 00:00:00"),
        ("8-5-2025", "2025-08-05 00:00:00"),
        ("Aug 5, 2025", "2025-08-05 00:00:00"),
        ("20250805", "2025-08-05 00:00:00"),
        ("2025-8-5 10:00", "2025-08-05 10:00:00"),
        ("8/5/25 1:05:09 PM", "2025-08-05 13:05:09"),
        ("8/5/25 12:05 am", "2025-08-05 00:05:00"),
        ("3/9/25 02:30", "2025-03-09 02:30:00"),
        ("13/05/2025", "2025-05-13 00:00:00"),
        ("05/13/99", "1999-05-13 00:00:00"),
        ("nan", None),
        ("45000", None),
        ("", None),
        ("2/30/2025", None),
        ("8/5/25 25:00", None),
        ("T12:30", None),
    ],
)
def test_parse_date(spark, one, text, expected):
    got = one(spark.createDataFrame([(text,)], "t string").select(ll.parse_date(F.col("t")).cast("string").alias("d")))
    assert got["d"] == expected


def test_parse_amount(spark):
    texts = ["$1,234.50", "- $28800.3", "(12.30)", "+ $5", " 7 ", "abc", "5d", "1e3", None, "", "(x)", "--5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def parsed(style):
        return [r[0] for r in df.select(ll.parse_amount(F.col("t"), style)).collect()]

    assert parsed("ledger") == [1234.5, None, None, None, 7, None, None, 1000, None, None, None, None]
    assert parsed("register") == [1234.5, -28800.3, -12.3, 5, 7, None, None, 1000, None, None, None, None]
    assert parsed("export") == [1234.5, -28800.3, -12.3, 5, 7, None, None, 1000, None, None, None, None]
    with pytest.raises(ValueError):
        ll.parse_amount(F.col("t"), "other")


def test_currency(spark, one):
    shown = [ll.currency(F.lit(x).cast("double")).alias(str(i)) for i, x in enumerate((1234.5, -1234.5, None))]
    assert list(one(spark.range(1).select(*shown)).values()) == ["$1,234.50", "$-1,234.50", "-"]


def test_month_helpers(spark):
    assert ll.prior_month("2025-03-15") == (dt.date(2025, 2, 1), dt.date(2025, 2, 28))
    assert ll.days_between("2025-08-01", "2025-08-31") == 30


def test_reconcile_exports(spark, tmp_path, one):
    bank = write(
        tmp_path / "bank.csv",
        "Transaction Date,Transaction Description,Amount\n"
        "08/20/2025,Check 7,- $100.00\n08/05/2025,Deposit,+ $50\n08/05/2025,Deposit,+ $50\n08/09/2025,Fee,- $9\n",
    )
    ledger = write(
        tmp_path / "ledger.csv",
        "Date,Num,Account,Name,Amount\n"
        "08/10/2025,7,PNC Checking,Smith,-100.00\n08/06/2025,,PNC Checking,Cust,50\n"
        "08/04/2025,,pnc checking,Cust,-50.01\n08/09/2025,,Cash,Fee,-9\n08/30/2025,,PNC,Late,1\n",
    )
    result, summary = ll.reconcile_exports(spark, bank, ledger)
    got = sorted((r.bank_index, r.qb_index, r.qb_name, r.qb_num) for r in result.matched.collect())
    assert got == [("0", "0", "Smith", "7"), ("1", "1", "Cust", ""), ("2", "2", "Cust", "")]
    totals = one(summary)
    assert (totals["total_matched"], totals["total_unmatched_bank"], totals["unmatched_bank_amount"]) == (3, 1, -9)
    assert (totals["total_unmatched_qb"], totals["unmatched_qb_amount"]) == (1, 1)


def test_reconcile_ledger(spark, one):
    ledger = spark.createDataFrame(
        [("1", "1/5/2025", "10", "N", "M"), ("2", "1/6/2025", "0", "N", "M"), ("3", "1/7/2025", "11", "", "x")],
        "_row_id string, date string, amount string, name string, memo string",
    )
    bank = spark.createDataFrame(
        [("a", "1/9/2025", "$10.00", "POS"), ("b", "1/9/2025", "(11.00)", "POS")],
        "bank_id string, `Posting Date` string, Amount string, Description string",
    )
    result, summary = ll.reconcile_ledger(ledger, bank)
    (row,) = result.matched.collect()
    assert (row.qb_index, row.bank_index, row.qb_description, row.bank_description) == ("1", "a", "N | M", "POS")
    totals = one(summary)
    assert (totals["total_unmatched_bank"], totals["unmatched_bank_amount"], totals["total_unmatched_qb"]) == (1, -11, 1)


def test_layouts_found_in_tasks_equal_those_found_one_by_one(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = [MESSY, "Date,Account,Amount\n1/2/2025,a,1\n", "Date,Account,Amount\n1/3/2025,b,2\n", "Café,Date\n1,2\n", ""]
    for i, text in enumerate(texts):
        write(folder / f"{i} export [{i}%].csv", text, "cp1252")
    one_by_one = ll.load_ledger(spark, str(folder))
    expected = rows(one_by_one, "_row_id", "account", "amount")
    monkeypatch.setattr("ledgerlake.sources.layout._FEW_FILES", 1)
    assert rows(ll.load_ledger(spark, str(folder)), "_row_id", "account", "amount") == expected
    assert len(expected) == 6


def test_wide_rows_are_an_error_outside_ledgers(spark, tmp_path):
    path = write(tmp_path / "w.csv", "Transaction Date,Transaction Description,Amount\n1/2/2025,a,1\n1/2/2025,b,2,3\n")
    with pytest.raises(Exception, match="expected 3 cells"):
        ll.load_bank_export(spark, path).collect()
    padded = write(tmp_path / "n.csv", "Transaction Date,Transaction Description,Amount\n1/2/2025,a\n\n1/3/2025,b,2\n")
    assert ll.load_bank_export(spark, padded).count() == 2


def test_header_below_a_very_long_cell(spark, tmp_path, monkeypatch):
    long_title = '"' + "line\n" * 700 + '"'
    texts = [f"{long_title}\nmore\nDate,Account,Amount\n1/2/2025,a,1\n", "Date,Account,Amount\n1/3/2025,b,2\n"]
    for i, text in enumerate(texts):
        write(tmp_path / f"{i}.csv", text)
    for few in (256, 0):
        monkeypatch.setattr("ledgerlake.sources.layout._FEW_FILES", few)
        assert rows(ll.load_ledger(spark, str(tmp_path)), "account", "amount") == [("a", 1), ("b", 2)]


def test_column_names_with_dots(spark, tmp_path):
    path = write(tmp_path / "l.csv", "Date,Account,Amt. (USD),Ref`no,Amount\n1/2/2025,a,x y,z,5\n1/3/2025,b,,z,6\n")
    ledger = ll.load_ledger(spark, path)
    assert ledger.columns[2:4] == ["amt._(usd)", "ref`no"]
    flagged = ll.flagged_ledger(ledger, rules=[{"name": "r", "account_contains": "a"}])
    table = ll.apply_rule_table(flagged, ll.rules_table(spark, ll.default_rules()))
    assert ll.non_null_counts(ll.redact_text(ll.render_dates(table))).first()["amt._(usd)"] == 1
    bank = flagged.withColumnRenamed("_row_id", "bank_id").where("amount = 5")
    assert [r["amount"] for r in ll.match_qb_and_bank(flagged, bank).unmatched_qb.collect()] == [6]


def test_further_spellings(spark):
    spelt = {
        "5 Aug 25": "2025-08-05 00:00:00", "Aug 2025": "2025-08-01 00:00:00", "2025-08": "2025-08-01 00:00:00",
        "Tuesday, August 5, 2025": "2025-08-05 00:00:00", "8.5.2025": "2025-08-05 00:00:00",
        "August 5 2025 3pm": "2025-08-05 15:00:00", "August 2025": "2025-08-01 00:00:00", "nonsense 5": "None",
    }
    rows = spark.createDataFrame([(s,) for s in spelt], "s string").select("s", ll.parse_date(F.col("s")).alias("d"))
    assert {r.s: str(r.d) for r in rows.collect()} == spelt


def test_header_search_in_one_job_equals_the_one_by_one(spark, tmp_path, monkeypatch):
    from ledgerlake.sources import layout

    folder = tmp_path / "long"
    folder.mkdir()
    cell = "x" * 900
    top = "".join(f"Report line {i} {cell}\n" for i in range(20))
    for name in ("a", "b"):
        write(folder / f"{name}.csv", top + "Date,Account,Amount\n" + f"1/2/2025,acc {name},{1.5}\n" * 40)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    try:
        files = [str(folder / f"{n}.csv") for n in "ab"]
        few = layout.discover_layouts(spark, files, ("date", "account"))
        monkeypatch.setattr(layout, "_FEW_FILES", 0)
        many = layout.discover_layouts(spark, files, ("date", "account"))
    finally:
        spark.conf.set(key, before)
    strip = lambda found: {k: sorted(f.removeprefix("file:").lstrip("/") for f in v) for k, v in found.items()}
    assert strip(few) == strip(many) and [k.header for k in many] == [("Date", "Account", "Amount")]


def test_rejects_are_counted_and_shown(spark, tmp_path):
    from pyspark.sql import Observation

    path = write(
        tmp_path / "r.csv",
        "Date,Account,Amount\n1/2/2025,a,1\n,,\n,subtotal,5\nsoon,b,2\n1/3/2025,c,3,extra\n1/4/2025,d,x\n",
    )
    seen = Observation()
    df = ll.load_ledger(spark, path, observation=seen)
    assert [r[0] for r in rows(df, "account")] == ["a", "d"] and "_wide" not in df.columns
    assert seen.get == {"kept": 2, "too_wide": 1, "blank": 1, "undated": 1, "unreadable_date": 1}
    rejects = ll.load_ledger_rejects(spark, path).collect()
    assert {(r["reason"], r["date_text"]) for r in rejects} == {
        ("blank", ""), ("undated", ""), ("unreadable_date", "soon"), ("too_wide", "1/3/2025"),
    }
    records = {r["reason"]: r["record"] for r in rejects}
    assert records["too_wide"] == "1/3/2025,c,3,extra" and '"account":"subtotal"' in records["undated"]
    assert all(r["file"].endswith("r.csv") for r in rejects)
    assert rows(ll.load_ledger(spark, path), "account") == [("a",), ("d",)]


def test_sparse_ids_depend_on_their_file_alone(spark, tmp_path):
    """A file read alone, and beside a much larger one, in splits of other sizes."""
    small = write(tmp_path / "a.csv", "Date,Account\n" + "".join(f"{'' if i % 9 == 0 else '1/2/2025'},acc {i}\n" for i in range(4000)))
    large = write(tmp_path / "b.csv", "Date,Account\n" + "".join(f"1/2/2025,other {i}\n" for i in range(40_000)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    ids = []
    try:
        for paths, size in (([small], "9000"), ([small, large], "50000"), ([small, large], "1000000")):
            spark.conf.set(key, size)
            df = ll.load_ledger(spark, paths, multiline=False, dense_ids=False)
            ids.append({(r["_row_id"], r["account"]) for r in df.where("account LIKE 'acc%'").collect()})
    finally:
        spark.conf.set(key, before)
    assert ids[0] == ids[1] == ids[2] and len(ids[0]) == sum(i % 9 != 0 for i in range(4000))
    assert {int(i.rpartition("#")[2]) for i, _ in ids[0]} == set(range(len(ids[0])))
