"""Classes, addbacks, rules, account views, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

import ledgerlake as ll

from .core import (
    flagged_sql,
    CLASSIFIED,
    FLAGGED,
    FLAGGED_PLAIN,
    LEDGER,
    PERIOD_START,
    TODAY,
    TOKENS,
    ledger,
    plain,
    query,
    table,
)

FLAGS = ("is_pnl", "is_revenue", "is_cogs", "is_overhead", "is_other_expense")


def flagged(spark, sf_dir, tokens=TOKENS):
    return ll.detect_addbacks(ll.classify_transactions(ledger(spark, sf_dir)), tokens)


@query(
    "classify_transactions",
    f"WITH {CLASSIFIED} SELECT _row_id, account_prefix, {', '.join(FLAGS)}, classification FROM classified",
)
def classify_transactions(spark, sf_dir):
    return ll.classify_transactions(ledger(spark, sf_dir)).select(
        "_row_id", "account_prefix", *FLAGS, "classification"
    )


@query(
    "classify_custom_prefixes",
    f"""WITH {CLASSIFIED} SELECT entity,
    CASE WHEN is_spent AND (contains(t, 'cost of goods sold') OR account_prefix IN ('700', '711')) THEN 'COGS'
         WHEN is_spent THEN 'Overhead' ELSE classification END AS classification,
    count(*) AS row_count, round(sum(amount), 2) AS amount FROM classified GROUP BY ALL""",
)
def classify_custom_prefixes(spark, sf_dir):
    classified = ll.classify_transactions(ledger(spark, sf_dir), cogs_prefixes={"700", "711"})
    return plain(
        classified.groupBy("entity", "classification").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("amount").alias("amount")
        )
    )


@query(
    "account_prefixes",
    f"""WITH {LEDGER}, odd AS (
    SELECT _row_id, CASE length(memo) % 3 WHEN 0 THEN concat(' ', account)
                    WHEN 1 THEN replace(account, '.', '') ELSE memo END AS code FROM ledger)
    SELECT _row_id, code, nullif(regexp_extract(code, '^\\s*(\\d{{3}})', 1), '') AS code_prefix,
           nullif(regexp_extract(code, '^\\s*(\\d+)', 1), '') AS full_prefix FROM odd""",
)
def account_prefixes(spark, sf_dir):
    kind = F.length("memo") % 3
    code = (
        F.when(kind == 0, F.concat(F.lit(" "), "account"))
        .when(kind == 1, F.replace("account", F.lit("."), F.lit("")))
        .otherwise(F.col("memo"))
    )
    return ledger(spark, sf_dir).select(
        "_row_id",
        code.alias("code"),
        ll.account_code_prefix(code).alias("code_prefix"),
        ll.extract_account_prefix(code).alias("full_prefix"),
    )


@query(
    "pnl_account_types",
    """WITH kinds AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE (l_partkey + l_linenumber) % 12 WHEN 0 THEN 'Bank' WHEN 1 THEN 'Accounts Payable' WHEN 2 THEN ' INCOME '
        WHEN 3 THEN 'Other Income' WHEN 4 THEN 'COGS' WHEN 5 THEN 'Fixed Asset' WHEN 6 THEN 'Bank Fee Expense'
        WHEN 7 THEN NULL WHEN 8 THEN '  ' WHEN 9 THEN 'Sales Revenue' WHEN 10 THEN 'Overhead' ELSE 'Long Term Liability' END AS kind
      FROM lineitem)
    SELECT kind, CASE WHEN kind IN (' INCOME ', 'Other Income', 'COGS') OR trim(coalesce(kind, '')) = '' THEN true ELSE false END AS is_pnl,
      CASE kind WHEN ' INCOME ' THEN 'revenue' WHEN 'Other Income' THEN 'revenue' WHEN 'Sales Revenue' THEN 'revenue'
        WHEN 'Bank Fee Expense' THEN 'overhead' WHEN 'Overhead' THEN 'overhead' ELSE 'other' END AS shown_as,
      count(*) AS row_count FROM kinds GROUP BY ALL""",
)
def pnl_account_types(spark, sf_dir):
    names = (
        "Bank", "Accounts Payable", " INCOME ", "Other Income", "COGS", "Fixed Asset",
        "Bank Fee Expense", None, "  ", "Sales Revenue", "Overhead", "Long Term Liability",
    )
    which = ((F.col("l_partkey") + F.col("l_linenumber")) % 12).cast("int")
    kind = F.get(F.array(*[F.lit(n).cast("string") for n in names]), which)
    return (
        table(spark, sf_dir, "lineitem")
        .select(kind.alias("kind"))
        .select(
            "kind",
            ll.is_pnl_account_type(F.col("kind")).alias("is_pnl"),
            ll.display_classification(F.col("kind")).alias("shown_as"),
        )
        .groupBy("kind", "is_pnl", "shown_as")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


@query(
    "detect_addbacks",
    f"WITH {FLAGGED} SELECT _row_id, sde_addback_flag, sde_addback_reason FROM flagged",
)
def detect_addbacks(spark, sf_dir):
    return flagged(spark, sf_dir).select("_row_id", "sde_addback_flag", "sde_addback_reason")


RULES = [
    {"name": "gears", "memo_contains": "GEAR", "amount": -30000, "amount_tolerance": 15000},
    {"name": "job_705", "account_contains": ["705.", "small"]},
    {"name": "exact", "amount": 50000.0},
    {"name": "weekly_payroll_addback_2880", "memo_contains": ["bolt"], "name_contains": ["7"]},
    {"name": "late", "memo_contains": ["ring"], "start_date": "2000-01-01"},
]


@query(
    "apply_addback_rules",
    f"""WITH {FLAGGED_PLAIN}, hits AS (SELECT *,
      contains(lower(memo), 'gear') AND abs(abs(amount) - 30000) <= 15000 AS r0,
      contains(lower(account), '705.') AND contains(lower(account), 'small') AS r1,
      abs(abs(amount) - 50000.0) <= 0.01 AS r2,
      contains(lower(memo), 'bolt') AND contains(lower(name), '7') AND date >= DATE '1999-01-15' AS r3,
      contains(lower(memo), 'ring') AND date >= DATE '2000-01-01' AS r4 FROM flagged)
    SELECT _row_id, sde_addback_flag OR r0 OR r1 OR r2 OR r3 OR r4 AS sde_addback_flag,
      concat_ws(', ', nullif(sde_addback_reason, ''), CASE WHEN r0 THEN 'rule=gears' END, CASE WHEN r1 THEN 'rule=job_705' END,
        CASE WHEN r2 THEN 'rule=exact' END, CASE WHEN r3 THEN 'rule=weekly_payroll_addback_2880' END,
        CASE WHEN r4 THEN 'rule=late' END) AS sde_addback_reason FROM hits""",
)
def apply_addback_rules(spark, sf_dir):
    import datetime as dt

    rows = flagged(spark, sf_dir, ())
    ruled = ll.apply_addback_rules(rows, RULES, payroll_start=dt.date(1999, 1, 15))
    return ruled.select("_row_id", "sde_addback_flag", "sde_addback_reason")


MANY_TOKENS = (*(f"{a}{b}" for a in ("bolt", "nut", "cog", "ring") for b in range(50)), "steel ring", "customer#000000003", "gear", "#000000007", "tin gear")


@query("detect_many_tokens", f"WITH {flagged_sql(MANY_TOKENS)} SELECT _row_id, sde_addback_flag, sde_addback_reason FROM flagged")
def detect_many_tokens(spark, sf_dir):
    """Some two hundred tokens, phrases among them; reasons go by the tokens' order."""
    rows = ll.detect_addbacks(ledger(spark, sf_dir), MANY_TOKENS)
    return rows.select("_row_id", "sde_addback_flag", "sde_addback_reason")


@query(
    "apply_text_rules",
    f"""WITH {LEDGER}, rules AS (
      SELECT c_custkey AS pos, right(c_name, 10) AS digits, CASE WHEN c_custkey % 2 = 1 THEN 'gear' ELSE '' END AS word FROM customer),
    hits AS (SELECT _row_id, string_agg('rule=' || pos, ', ' ORDER BY pos) AS reason
      FROM ledger JOIN rules ON contains(lower(name), digits) AND contains(lower(memo), word) GROUP BY _row_id)
    SELECT _row_id, reason IS NOT NULL AS sde_addback_flag, coalesce(reason, '') AS sde_addback_reason
    FROM ledger LEFT JOIN hits USING (_row_id)""",
)
def apply_text_rules(spark, sf_dir):
    """A rule for each customer, thousands of them, none with an amount."""
    rules = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pos"),
        F.col("c_custkey").cast("string").alias("name"),
        F.array(F.right("c_name", F.lit(10))).alias("name_contains"),
        F.when(F.col("c_custkey") % 2 == 1, F.array(F.lit("Gear "))).alias("memo_contains"),
    )
    ruled = ll.apply_rule_table(ledger(spark, sf_dir), rules)
    return ruled.select("_row_id", "sde_addback_flag", "sde_addback_reason")


@query(
    "apply_rule_table",
    f"""WITH {LEDGER}, rules AS (
      SELECT p_name, 10000 + 1000 * min(p_size) AS target FROM part GROUP BY p_name),
    hits AS (SELECT _row_id, string_agg('rule=' || p_name, ', ' ORDER BY p_name) AS reason
      FROM ledger JOIN rules ON contains(lower(memo), p_name) AND abs(abs(amount) - target) <= 2500 GROUP BY _row_id)
    SELECT _row_id, reason IS NOT NULL AS sde_addback_flag, coalesce(reason, '') AS sde_addback_reason
    FROM ledger LEFT JOIN hits USING (_row_id)""",
)
def apply_rule_table(spark, sf_dir):
    rules = (
        table(spark, sf_dir, "part")
        .groupBy("p_name")
        .agg((F.lit(10000.0) + 1000 * F.min("p_size")).alias("amount"))
        .select(
            F.col("p_name").alias("pos"),
            F.col("p_name").alias("name"),
            F.split("p_name", " ").alias("memo_contains"),
            "amount",
            F.lit(2500.0).alias("amount_tolerance"),
        )
    )
    ruled = ll.apply_rule_table(ledger(spark, sf_dir), rules)
    return ruled.select("_row_id", "sde_addback_flag", "sde_addback_reason")


@query(
    "apply_rule_table_by_entity",
    f"""WITH {LEDGER}, rules AS (
      SELECT DISTINCT c_mktsegment AS entity, c_nationkey AS pos FROM customer),
    hits AS (SELECT _row_id, string_agg('rule=nation_' || pos, ', ' ORDER BY pos) AS reason
      FROM ledger JOIN rules ON ledger.entity = rules.entity AND contains(name, '#000') AND contains(name, CAST(pos AS VARCHAR))
       AND abs(abs(amount) - 1500 * pos) <= 800 AND date >= DATE '1995-01-01' + 50 * pos GROUP BY _row_id)
    SELECT _row_id, reason IS NOT NULL AS sde_addback_flag, coalesce(reason, '') AS sde_addback_reason
    FROM ledger LEFT JOIN hits USING (_row_id)""",
)
def apply_rule_table_by_entity(spark, sf_dir):
    key = F.col("c_nationkey")
    rules = (
        table(spark, sf_dir, "customer")
        .select(F.col("c_mktsegment").alias("entity"), "c_nationkey")
        .distinct()
        .select(
            "entity",
            key.alias("pos"),
            F.concat(F.lit("nation_"), key.cast("string")).alias("name"),
            F.array(F.lit("#000"), key.cast("string")).alias("name_contains"),
            (key * 1500.0).alias("amount"),
            F.lit(800.0).alias("amount_tolerance"),
            F.date_add(F.lit("1995-01-01").cast("date"), key * 50).alias("start_date"),
        )
    )
    ruled = ll.apply_rule_table(ledger(spark, sf_dir), rules, by="entity")
    return ruled.select("_row_id", "sde_addback_flag", "sde_addback_reason")


ADDBACK_ACCOUNTS = ("700.001 · SMALL", "705.010 · ECONOMY", "711.003 · LARGE")


@query(
    "account_summary",
    f"""WITH {LEDGER} SELECT account, account_type,
      CASE account_type WHEN 'Income' THEN 'revenue' WHEN 'Cost of Goods Sold' THEN 'cogs' WHEN 'Expense' THEN 'overhead' ELSE 'other' END AS classification,
      round(sum(amount), 2) AS ytd_amount, account IN {ADDBACK_ACCOUNTS} AS is_addback
    FROM ledger WHERE date >= DATE '{PERIOD_START}' AND date <= DATE '{TODAY}' GROUP BY account, account_type""",
)
def account_summary(spark, sf_dir):
    return plain(
        ll.build_account_summary(ledger(spark, sf_dir), PERIOD_START, TODAY, ADDBACK_ACCOUNTS)
    )


@query(
    "account_summary_by_entity",
    f"""WITH {LEDGER} SELECT entity, account, account_type,
      CASE account_type WHEN 'Income' THEN 'revenue' WHEN 'Cost of Goods Sold' THEN 'cogs' WHEN 'Expense' THEN 'overhead' ELSE 'other' END AS classification,
      round(sum(amount), 2) AS ytd_amount, false AS is_addback
    FROM ledger WHERE date BETWEEN DATE '1996-01-01' AND DATE '{TODAY}' GROUP BY entity, account, account_type""",
)
def account_summary_by_entity(spark, sf_dir):
    return plain(ll.build_account_summary(ledger(spark, sf_dir), "1996-01-01", TODAY, by="entity"))


COUNTED = ("date", "account", "account_type", "name", "memo", "amount", "account_prefix")


@query(
    "profile_counts",
    f"""WITH {CLASSIFIED} SELECT {", ".join(f"count({c}) AS {c}" for c in COUNTED if c != "account_type")},
    count(nullif(account_type, '')) AS account_type FROM classified""",
)
def profile_counts(spark, sf_dir):
    rows = ll.classify_transactions(ledger(spark, sf_dir)).withColumn(
        "account_type", F.nullif("account_type", F.lit(""))
    )
    return ll.non_null_counts(rows.select(*COUNTED))


@query(
    "value_counts",
    f"""WITH {LEDGER} SELECT entity, account_type, count(*) AS "count" FROM ledger GROUP BY entity, account_type""",
)
def value_counts(spark, sf_dir):
    return ll.value_counts(ledger(spark, sf_dir), "account_type", by="entity")


@query(
    "ledger_totals",
    f"""WITH {LEDGER} SELECT entity, count(*) AS "rows", CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
      round(sum(amount), 2) AS total_amount, round(sum(amount) FILTER (WHERE account_type ILIKE '%income%'), 2) AS income_amount
    FROM ledger GROUP BY entity""",
)
def ledger_totals(spark, sf_dir):
    return plain(ll.ledger_totals(ledger(spark, sf_dir), by="entity"))


@query(
    "distinct_accounts",
    f"WITH {LEDGER} SELECT DISTINCT account FROM ledger ORDER BY account LIMIT 10",
)
def distinct_accounts(spark, sf_dir):
    return ll.distinct_accounts(ledger(spark, sf_dir))


@query(
    "filter_account",
    f"""WITH {LEDGER} SELECT _row_id, account, round(amount, 2) AS amount FROM ledger WHERE account ILIKE '%Eco%'""",
)
def filter_account(spark, sf_dir):
    rows = ll.filter_account(ledger(spark, sf_dir), "eCo")
    return plain(rows.select("_row_id", "account", "amount"))


@query(
    "addback_totals",
    f"""WITH {FLAGGED} SELECT entity, count(*) FILTER (WHERE sde_addback_flag) AS addback_count,
      round(sum(amount) FILTER (WHERE sde_addback_flag), 2) AS addback_amount FROM flagged GROUP BY entity""",
)
def addback_totals(spark, sf_dir):
    return plain(ll.addback_totals(flagged(spark, sf_dir), by="entity"))


@query(
    "addback_listing",
    f"""WITH {FLAGGED} SELECT _row_id, CAST(date AS VARCHAR) AS date, name, memo, round(amount, 2) AS amount, sde_addback_reason
    FROM flagged WHERE sde_addback_flag ORDER BY flagged.date, _row_id LIMIT 10""",
)
def addback_listing(spark, sf_dir):
    return plain(ll.addback_listing(flagged(spark, sf_dir)))


@query(
    "ledger_preview",
    f"""WITH {LEDGER} SELECT _row_id, entity, CAST(date AS VARCHAR) AS date, account, account_type, name, memo, round(amount, 2) AS amount
    FROM ledger ORDER BY ledger.date, _row_id LIMIT 50""",
)
def ledger_preview(spark, sf_dir):
    return plain(ll.preview(ledger(spark, sf_dir), ["date", "_row_id"], 50))
