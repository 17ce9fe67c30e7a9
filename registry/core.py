"""Registration, output shaping, and the ledger-shaped views of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Parameters used throughout: the period, the ownership cut-over, the end of the first year.
PERIOD_START, CUT_OVER, TODAY, YEAR_END = "1998-07-01", "1998-08-01", "1998-12-31", "1999-06-30"
TOKENS = ("ring", "gear")


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def plain(df: DataFrame, digits: int = 2) -> DataFrame:
    """Dates as text and doubles rounded, so that results compare the same everywhere."""
    shown = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, digits) + F.lit(0.0)
        shown.append(column.alias(field.name))
    return df.select(*shown)


def two_decimals(name: str) -> Column:
    """A number as text without digit grouping."""
    return F.replace(F.format_number(name, 2), F.lit(","), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a general ledger; the market segment is the company."""
    lines, orders, customers, parts = (
        table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part")
    )
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    number = F.col("l_linenumber")
    kind = (
        F.when(number == 1, "Income")
        .when(number == 2, "Cost of Goods Sold")
        .when(number.isin(3, 5), "Expense")
        .when(number == 4, "Other Expense")
        .when(number == 6, "Bank")
        .otherwise("")
    )
    day = F.to_date("l_shipdate")
    row_id = F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        day.cast("string"),
    )
    account = F.concat(
        (F.lit(700) + F.col("l_partkey") % 12).cast("string"),
        F.lit("."),
        F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0"),
        F.lit(" · "),
        F.col("p_type"),
    )
    price = F.col("l_extendedprice")
    return joined.select(
        row_id.alias("_row_id"),
        F.col("c_mktsegment").alias("entity"),
        day.alias("date"),
        account.alias("account"),
        kind.alias("account_type"),
        F.col("c_name").alias("name"),
        F.col("p_name").alias("memo"),
        F.round(F.when(number == 1, -8 * price).otherwise(price), 2).alias("amount"),
    )


def bank_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of the bank account, amounts rounded to 500 so that many are equal."""
    rows = ledger(spark, sf_dir).where(F.col("account_type") == "Bank")
    return rows.withColumn("amount", F.round(F.col("amount") / 500) * 500).select(
        "_row_id", "entity", "date", "amount", "name", "memo", "account"
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank register made from them: days shifted, some signs turned, some rows missing."""
    rows = bank_ledger(spark, sf_dir).where(F.length("memo") % 4 != 0)
    flipped = F.month("date") % 6 == 0
    return rows.select(
        F.col("_row_id").alias("bank_id"),
        "entity",
        F.date_add("date", F.day("date") % 19 - 4).alias("date"),
        F.when(flipped, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        F.concat(F.lit("POS "), F.col("name")).alias("description"),
    )


LEDGER = """ledger AS (
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                 CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS _row_id,
       c_mktsegment AS entity, CAST(l_shipdate AS DATE) AS date,
       concat(CAST(700 + l_partkey % 12 AS VARCHAR), '.',
              lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0'), ' · ', p_type) AS account,
       CASE l_linenumber WHEN 1 THEN 'Income' WHEN 2 THEN 'Cost of Goods Sold' WHEN 3 THEN 'Expense'
            WHEN 4 THEN 'Other Expense' WHEN 5 THEN 'Expense' WHEN 6 THEN 'Bank' ELSE '' END AS account_type,
       c_name AS name, p_name AS memo,
       round(CASE WHEN l_linenumber = 1 THEN -8 * l_extendedprice ELSE l_extendedprice END, 2) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""

BANK_LEDGER = (
    LEDGER
    + """,
bank_ledger AS (
SELECT _row_id, entity, date, round(amount / 500) * 500 AS amount, name, memo, account
FROM ledger WHERE account_type = 'Bank')"""
)

BANK = (
    BANK_LEDGER
    + """,
bank AS (
SELECT _row_id AS bank_id, entity, date + CAST(day(date) % 19 - 4 AS INT) AS date,
       CASE WHEN month(date) % 6 = 0 THEN -amount ELSE amount END AS amount,
       concat('POS ', name) AS description
FROM bank_ledger WHERE length(memo) % 4 <> 0)"""
)

CLASSIFIED = (
    LEDGER
    + """,
typed AS (SELECT *, lower(account_type) AS t, lower(account) AS a FROM ledger),
pnl AS (
SELECT *, CASE WHEN regexp_matches(t, 'bank|accounts payable|accounts receivable|credit card|fixed asset|other current asset|other current liability|long term liability|equity') THEN false
               WHEN regexp_matches(t, 'income|expense|cost of goods sold|cogs') THEN true
               ELSE trim(t) IN ('', 'nan') END AS is_pnl,
       nullif(regexp_extract(account, '^\\s*(\\d+)', 1), '') AS account_prefix FROM typed),
revenue AS (SELECT *, is_pnl AND (contains(t, 'income') OR contains(a, 'income')) AS is_revenue FROM pnl),
other AS (SELECT *, is_pnl AND NOT is_revenue AND (contains(t, 'other expense') OR contains(t, 'other income')) AS is_other_expense FROM revenue),
spent AS (SELECT *, is_pnl AND NOT is_revenue AND NOT is_other_expense AND (contains(t, 'expense') OR contains(t, 'cost of goods sold') OR contains(t, 'cogs')) AS is_spent FROM other),
cogs AS (SELECT *, is_spent AND (contains(t, 'cost of goods sold') OR trim(t) = 'cogs' OR coalesce(account_prefix IN ('704', '705', '706', '707', '708'), false)) AS is_cogs FROM spent),
classified AS (
SELECT *, is_spent AND NOT is_cogs AS is_overhead,
       CASE WHEN is_revenue THEN 'Revenue' WHEN is_cogs THEN 'COGS' WHEN is_spent THEN 'Overhead'
            WHEN is_other_expense THEN 'Other' WHEN is_pnl AND t = '' THEN 'Unclassified'
            WHEN is_pnl THEN 'Other' ELSE 'Balance Sheet' END AS classification FROM cogs)"""
)


def flagged_sql(tokens: tuple[str, ...]) -> str:
    words = ("xnp", "ng", "nathan", "owner", "personal", *tokens)

    def hit(word: str) -> str:
        return f"(regexp_matches(lower(name), '\\b{word}\\b') OR regexp_matches(lower(memo), '\\b{word}\\b'))"

    reasons = ", ".join(f"CASE WHEN {hit(w)} THEN 'token={w}' END" for w in words)
    return f"""{CLASSIFIED},
flagged AS (
SELECT *, {" OR ".join(hit(w) for w in words)} AS sde_addback_flag,
       concat_ws(', ', {reasons}) AS sde_addback_reason FROM classified)"""


FLAGGED = flagged_sql(TOKENS)
FLAGGED_PLAIN = flagged_sql(())


def size(condition: str) -> str:
    return f"abs(coalesce(sum(amount) FILTER (WHERE {condition}), 0))"


def addbacks(condition: str) -> str:
    return (
        f"coalesce(sum(amount) FILTER (WHERE ({condition}) AND amount > 0),"
        f" -sum(amount) FILTER (WHERE ({condition}) AND amount < 0), 0)"
    )


def period_cte(name: str, where: str = "true", by: str = "", source: str = "flagged") -> str:
    """SQL for the plain period metrics."""
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""{name}_sums AS (
SELECT {lead}{size(f"is_revenue AND {where}")} AS revenue, {size(f"is_cogs AND {where}")} AS cogs,
       {size(f"is_overhead AND {where}")} AS overhead, {size(f"is_other_expense AND {where}")} AS other_expense,
       {addbacks(f"sde_addback_flag AND {where}")} AS addbacks FROM {source} {group}),
{name} AS (SELECT *, revenue - cogs AS gross_profit, revenue - (cogs + overhead + other_expense) AS net_profit,
       revenue - (cogs + overhead + other_expense) + addbacks AS sde FROM {name}_sums)"""


def rounded(columns, digits: int = 2, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, {digits}) + 0.0 AS {c}" for c in columns)
