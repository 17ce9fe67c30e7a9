"""Cleaning of raw text rows, scalar parsing, rendering, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

import ledgerlake as ll

from .core import plain, query, table, two_decimals

STAMP = "'%Y-%m-%d %H:%M:%S'"

# How event times are spelt in turn, as (Spark format, what is left of the time of day).
DATE_SPELLINGS = (
    ("MM/dd/yyyy", "day"),
    ("yyyy-MM-dd HH:mm:ss", "day"),
    ("yyyy/M/d", "day"),
    ("MM/dd/yy", "day"),
    ("MMM d, yyyy", "day"),
    ("yyyyMMdd", "day"),
    ("M-d-yyyy", "day"),
    ("yyyy-M-d H:mm", "kept"),
    ("M/d/yy HH:mm:ss", "kept"),
)


@query(
    "parse_dates",
    f"""SELECT event_id, CASE event_id % 10 WHEN 9 THEN NULL
      WHEN 7 THEN CASE WHEN month(ts) >= 10 AND day(ts) >= 10 THEN strftime(date_trunc('day', ts), {STAMP}) ELSE strftime(date_trunc('minute', ts), {STAMP}) END
      WHEN 8 THEN strftime(date_trunc('second', ts), {STAMP})
      ELSE strftime(date_trunc('day', ts), {STAMP}) END AS parsed FROM events""",
)
def parse_dates(spark, sf_dir):
    which = F.col("event_id") % 10
    spelt = F.lit(None).cast("string")
    for i, (fmt, _) in enumerate(DATE_SPELLINGS):
        spelt = F.when(which == i, F.date_format("ts", fmt)).otherwise(spelt)
    spelt = F.when(which == 9, F.concat(F.lit("n/a "), F.col("event_type"))).otherwise(spelt)
    events = table(spark, sf_dir, "events").select("event_id", spelt.alias("text"))
    return plain(events.select("event_id", ll.parse_date(F.col("text")).alias("parsed")))


# How event values are spelt in turn; {} is the value with two decimals.
MONEY_SPELLINGS = ("${}", "- ${}", "({})", "abc", "+ ${}", "{}d", " {} ")


@query(
    "parse_amounts",
    """WITH v AS (SELECT event_id, event_id % 7 AS k, round(value * 100, 2) AS x FROM events)
    SELECT event_id, CASE WHEN k IN (0, 6) THEN x END AS ledger_amount,
      CASE WHEN k IN (0, 4, 6) THEN x WHEN k IN (1, 2) THEN -x END AS register_amount,
      CASE WHEN k IN (0, 4, 6) THEN x WHEN k IN (1, 2) THEN -x END AS export_amount,
      CASE WHEN k = 6 THEN x END AS strict_amount FROM v""",
)
def parse_amounts(spark, sf_dir):
    which = F.col("event_id") % 7
    grouped = F.format_number(F.round(F.col("value") * 100, 2), 2)
    spelt = F.lit(None).cast("string")
    for i, pattern in enumerate(MONEY_SPELLINGS):
        lead, tail = pattern.split("{}") if "{}" in pattern else (None, None)
        shown = F.lit(pattern) if lead is None else F.concat(F.lit(lead), grouped, F.lit(tail))
        spelt = F.when(which == i, shown).otherwise(spelt)
    events = table(spark, sf_dir, "events").select("event_id", spelt.alias("text"))
    amount = F.col("text")
    strict = ll.to_number(F.translate(F.when(F.startswith("text", F.lit(" ")), amount), ",", ""))
    return plain(
        events.select(
            "event_id",
            ll.parse_amount(amount, "ledger").alias("ledger_amount"),
            ll.parse_amount(amount, "register").alias("register_amount"),
            ll.parse_amount(amount, "export").alias("export_amount"),
            strict.alias("strict_amount"),
        )
    )


@query(
    "format_currency",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped,
      CASE WHEN l_linenumber = 7 THEN '-' WHEN l_linenumber = 1 THEN '$-' || format('{:,.2f}', l_extendedprice)
           ELSE '$' || format('{:,.2f}', l_extendedprice) END AS shown FROM lineitem""",
)
def format_currency(spark, sf_dir):
    price = F.col("l_extendedprice")
    signed = F.when(F.col("l_linenumber") == 1, -price).when(F.col("l_linenumber") < 7, price)
    return plain(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.to_date("l_shipdate").alias("shipped"),
            ll.currency(signed).alias("shown"),
        )
    )


@query(
    "month_bounds",
    """SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
      strftime(o_orderdate, '%b %Y') AS month_str, CAST(CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS prior_start,
      CAST(CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS prior_end,
      CAST(date_diff('day', CAST(date_trunc('month', o_orderdate) AS DATE), CAST(o_orderdate AS DATE)) AS INT) AS days_in FROM orders""",
)
def month_bounds(spark, sf_dir):
    day = F.col("o_orderdate")
    month = ll.month_start(day)
    return plain(
        table(spark, sf_dir, "orders").select(
            "o_orderkey",
            month.alias("month"),
            ll.month_label(month).alias("month_str"),
            ll.prior_month_start(day).alias("prior_start"),
            ll.prior_month_end(day).alias("prior_end"),
            F.date_diff(F.to_date(day), month).alias("days_in"),
        )
    )


def raw_ledger(spark, sf_dir):
    """Order lines as an untidy text export: odd names, repeats, blanks, subtotals, no amount."""
    number = F.col("l_linenumber")
    price = F.format_number("l_extendedprice", 2)
    dated = F.date_format("l_shipdate", "MM/dd/yyyy")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("x").alias("Unnamed: 0"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(" Num "),
        F.when(number == 7, F.lit("Total")).otherwise(dated).alias("Txn Date"),
        F.col("l_returnflag").alias("ACCOUNT"),
        F.when(number % 2 == 0, F.concat(F.lit("$"), price)).alias("Debit"),
        F.when(number == 3, F.lit("n/a")).when(number % 2 == 1, price).alias("Credit"),
        F.col("l_linestatus").alias("Memo"),
        F.lit("second").alias("memo "),
    )


@query(
    "clean_ledger",
    f"""SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS num, strftime(l_shipdate, '%m/%d/%Y') AS txn_date,
      strftime(l_shipdate, {STAMP}) AS date, l_returnflag AS account, '' AS account_type, '' AS name, l_linestatus AS memo,
      CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice WHEN l_linenumber = 3 THEN 0.0 ELSE -l_extendedprice END AS amount
    FROM lineitem WHERE l_linenumber <> 7""",
)
def clean_ledger(spark, sf_dir):
    rows = ll.clean_ledger(raw_ledger(spark, sf_dir))
    return plain(
        rows.select("num", "txn_date", "date", "account", "account_type", "name", "memo", "amount")
    )


@query(
    "clean_ledger_rejects",
    """SELECT CASE l_linenumber WHEN 7 THEN 'unreadable_date' WHEN 6 THEN 'undated' ELSE 'blank' END AS reason,
      CASE l_linenumber WHEN 7 THEN 'Total' ELSE '' END AS date_text,
      CASE WHEN l_linenumber <> 5 THEN concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) END AS num
    FROM lineitem WHERE l_linenumber >= 5""",
)
def clean_ledger_rejects(spark, sf_dir):
    """Rows left out of the export, with the reason; every fifth line blanked out, every sixth without a date."""
    number = F.split(F.col("` Num `"), "/")[1]
    raw = raw_ledger(spark, sf_dir)
    rows = raw.select(
        *[
            F.when((number != "5") & ~((number == "6") & F.lit(c == "Txn Date")), F.col(f"`{c}`")).alias(c)
            for c in raw.columns
        ]
    )
    rejects = ll.ledger_rejects(rows)
    return rejects.select("reason", "date_text", F.get_json_object("record", "$.num").alias("num"))


@query(
    "clean_transaction_detail",
    f"""SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS num, strftime(l_shipdate, {STAMP}) AS date,
      'C' || l_suppkey AS name, '' AS memo, l_returnflag AS account, l_linestatus AS account_type,
      CASE WHEN l_extendedprice >= 1000 AND l_linenumber = 2 THEN 0.0 ELSE l_extendedprice END AS amount
    FROM lineitem WHERE l_linenumber <> 5""",
)
def clean_transaction_detail(spark, sf_dir):
    number = F.col("l_linenumber")
    detail = table(spark, sf_dir, "lineitem").select(
        F.when(number != 5, F.lit("Bill")).alias("Type"),
        F.date_format("l_shipdate", "MM/dd/yy").alias("Date"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("Num"),
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("Name"),
        F.lit(None).cast("string").alias("Memo"),
        F.col("l_returnflag").alias("Account"),
        F.format_number("l_extendedprice", 2).alias("_grouped"),
        two_decimals("l_extendedprice").alias("_bare"),
        F.col("l_linestatus").alias("Account Type"),
        number,
    )
    amount = F.when(number == 2, F.col("_grouped")).otherwise(F.col("_bare"))
    raw = detail.withColumn("Amount", amount).drop("_grouped", "_bare", "l_linenumber")
    return plain(
        ll.clean_transaction_detail(raw).select(
            "num", "date", "name", "memo", "account", "account_type", "amount"
        )
    )


def raw_register(spark, sf_dir):
    """Events as a bank export."""
    grouped = F.format_number(F.round(F.col("value") * 100, 2), 2)
    sign = F.when(F.col("event_id") % 3 == 0, "- $").when(F.col("event_id") % 3 == 1, "+ $").otherwise("$")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "M/d/yyyy")).alias("Transaction Date"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias(
            "Transaction Description"
        ),
        F.when(F.col("event_id") % 13 == 0, F.lit("void")).otherwise(F.concat(sign, grouped)).alias("Amount"),
    )


REGISTER_SQL = f"""r AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN strftime(date_trunc('day', ts), {STAMP}) END AS date,
    event_type || ' ' || event_id AS description,
    CASE WHEN event_id % 13 = 0 THEN 0.0 WHEN event_id % 3 = 0 THEN -round(value * 100, 2) ELSE round(value * 100, 2) END AS amount FROM events)"""


@query(
    "clean_bank_export",
    f"WITH {REGISTER_SQL} SELECT date, description AS transaction_description, amount + 0.0 AS amount FROM r",
)
def clean_bank_export(spark, sf_dir):
    rows = ll.clean_bank_export(raw_register(spark, sf_dir))
    return plain(rows.select("date", "transaction_description", "amount"))


@query(
    "normalize_bank_register",
    f"WITH {REGISTER_SQL} SELECT date, description, amount, 'bank' AS source FROM r WHERE date IS NOT NULL AND amount <> 0",
)
def normalize_bank_register(spark, sf_dir):
    return plain(ll.normalize_bank_register(raw_register(spark, sf_dir)))


@query(
    "render_dates",
    f"""SELECT event_id, strftime(ts, {STAMP}) AS moment, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d') AS midnight FROM events""",
)
def render_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("moment"),
        F.to_date("ts").alias("day"),
        F.to_date("ts").cast("timestamp_ntz").alias("midnight"),
    )
    return ll.render_dates(rows)


@query(
    "redact_text",
    r"""WITH shown AS (SELECT page_id, CASE page_id % 5
        WHEN 0 THEN 'see ' || url || ' now'
        WHEN 1 THEN 'got ' || url || '/Upload/' || page_id || ' done'
        WHEN 2 THEN 'at C:\\data\\' || page_id || '.csv and ' || url
        WHEN 3 THEN 'File-ID: ' || page_id || ', from \\\\host-1\\share\\x'
        ELSE 'widget_id=' || page_id || '; ' || url || '&file_id=9' END AS note FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'got <REDACTED_URL> done'
        WHEN 2 THEN regexp_replace(note, '[A-Z]:[^ ]+', '<REDACTED_PATH>')
        WHEN 3 THEN '<REDACTED_ID>, from <REDACTED_PATH>'
        WHEN 4 THEN '<REDACTED_ID>; <REDACTED_URL>' ELSE note END AS note FROM shown""",
)
def redact_text(spark, sf_dir):
    page, url = F.col("page_id").cast("string"), F.col("url")
    kind = F.col("page_id") % 5
    note = (
        F.when(kind == 0, F.concat(F.lit("see "), url, F.lit(" now")))
        .when(kind == 1, F.concat(F.lit("got "), url, F.lit("/Upload/"), page, F.lit(" done")))
        .when(kind == 2, F.concat(F.lit("at C:\\\\data\\\\"), page, F.lit(".csv and "), url))
        .when(kind == 3, F.concat(F.lit("File-ID: "), page, F.lit(", from \\\\\\\\host-1\\\\share\\\\x")))
        .otherwise(F.concat(F.lit("widget_id="), page, F.lit("; "), url, F.lit("&file_id=9")))
    )
    rows = table(spark, sf_dir, "pages").select(
        "page_id", note.alias("note"), url.alias("upload_url"), page.alias("machine_name")
    )
    return ll.redact_text(rows)
