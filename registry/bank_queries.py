"""Bank normalisation, matching, reconciliation, cash and accrual results."""

from __future__ import annotations

from pyspark.sql import functions as F

import ledgerlake as ll

from .core import BANK, LEDGER, bank, bank_ledger, ledger, plain, query

START, END = "1996-01-01", "1998-12-31"


@query(
    "normalize_ledger_for_bank",
    f"""WITH {LEDGER} SELECT _row_id, strftime(date, '%Y-%m-%d 00:00:00') AS date, round(amount, 2) AS amount,
      trim(CASE WHEN length(memo) % 2 = 0 THEN '' ELSE name END || ' | ' || memo, ' |') AS description, account, 'qb' AS source
    FROM ledger WHERE date IS NOT NULL AND amount <> 0""",
)
def normalize_ledger_for_bank(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("name", F.when(F.length("memo") % 2 != 0, F.col("name")))
    return plain(ll.normalize_qb_ledger_for_bank(rows, keep="_row_id"))


@query(
    "normalize_bank",
    f"""WITH {BANK} SELECT bank_id, strftime(date, '%Y-%m-%d 00:00:00') AS date, amount, description, 'bank' AS source
    FROM bank WHERE amount <> 0""",
)
def normalize_bank(spark, sf_dir):
    rows = bank(spark, sf_dir).withColumnRenamed("date", "Posting Date")
    return plain(ll.normalize_bank_register(rows, keep="bank_id"))


def matched_sql(by: str = "", first: str = "date, ") -> str:
    """The greedy loop as a fold: the takers of one amount in order, each adding its pick.

    A fold's state has the type of its elements, hence the unused picks in every taker.
    """
    key = f"{by}, " if by else ""
    same = f"q.{by} = b.{by} AND " if by else ""
    return f"""WITH {BANK},
takers AS (SELECT {key}CAST(round_even(amount * 100, 0) AS BIGINT) AS cents,
    list({{'x': date_diff('day', DATE '1970-01-01', date), 'picks': CAST([] AS BIGINT[])}} ORDER BY {first}_row_id) AS wants,
    list(_row_id ORDER BY {first}_row_id) AS ids FROM bank_ledger GROUP BY ALL),
pool AS (SELECT {key}CAST(round_even(amount * 100, 0) AS BIGINT) AS cents,
    list(date_diff('day', DATE '1970-01-01', date) ORDER BY {first}bank_id) AS days,
    list(bank_id ORDER BY {first}bank_id) AS ids FROM bank GROUP BY ALL),
folded AS (SELECT {key.replace(by, "q." + by) if by else ""}q.cents, q.ids AS taker_ids, b.ids AS pool_ids,
    list_reduce(q.wants, lambda done, w: {{'x': w.x, 'picks': list_append(done.picks, coalesce(
        list_min([CASE WHEN abs(b.days[i] - w.x) <= 14 AND NOT list_contains(done.picks, i)
                       THEN abs(b.days[i] - w.x) * 1000000000 + i END FOR i IN range(1, len(b.days) + 1)]) % 1000000000, 0))}},
      {{'x': CAST(0 AS BIGINT), 'picks': CAST([] AS BIGINT[])}}).picks AS picks
  FROM takers q JOIN pool b ON {same}q.cents = b.cents),
pairs AS (SELECT unnest(taker_ids) AS qb_index, unnest(picks) AS pick, pool_ids FROM folded),
matched AS (SELECT qb_index, pool_ids[pick] AS bank_index FROM pairs WHERE pick > 0)"""


def result(spark, sf_dir, by=()):
    return ll.match_qb_and_bank(bank_ledger(spark, sf_dir), bank(spark, sf_dir), by=by)


@query(
    "match_ledger_bank",
    f"""{matched_sql()} SELECT qb_index, bank_index, CAST(q.date AS VARCHAR) AS qb_date, q.amount AS qb_amount, '' AS qb_description,
      account AS qb_account, CAST(b.date AS VARCHAR) AS bank_date, b.amount AS bank_amount, b.description AS bank_description
    FROM matched JOIN bank_ledger q ON qb_index = q._row_id JOIN bank b ON bank_index = b.bank_id""",
)
def match_ledger_bank(spark, sf_dir):
    return plain(result(spark, sf_dir).matched)


@query("match_ledger_bank_by_entity", f"{matched_sql('entity')} SELECT entity, qb_index, m.bank_index FROM matched m JOIN bank ON m.bank_index = bank_id")
def match_ledger_bank_by_entity(spark, sf_dir):
    return result(spark, sf_dir, "entity").matched.select("entity", "qb_index", "bank_index")


@query("match_ledger_bank_by_day_counts", f"{matched_sql()} SELECT qb_index, bank_index FROM matched")
def match_ledger_bank_by_day_counts(spark, sf_dir):
    """The same result with the longer groups served from counts, as the hottest amounts are."""
    found = ll.match_qb_and_bank(bank_ledger(spark, sf_dir), bank(spark, sf_dir), max_group_rows=50)
    return found.matched.select("qb_index", "bank_index")


@query("match_ledger_bank_in_blocks", f"{matched_sql(first='')} SELECT qb_index, bank_index FROM matched")
def match_ledger_bank_in_blocks(spark, sf_dir):
    """Rows served in the order of their ids; the longer groups cut into blocks."""
    found = ll.match_qb_and_bank(
        bank_ledger(spark, sf_dir),
        bank(spark, sf_dir),
        qb_order=["_row_id"],
        bank_order=["bank_id"],
        max_group_rows=100,
        block_rows=50,
    )
    return found.matched.select("qb_index", "bank_index")


@query(
    "nearest_bank_row",
    f"""WITH {BANK},
q AS (SELECT * REPLACE (CASE WHEN length(memo) % 7 <> 0 THEN date END AS date, CASE WHEN length(name) % 5 <> 0 THEN amount END AS amount) FROM bank_ledger),
near AS (SELECT _row_id, bank_id, b.date AS bank_date, abs(date_diff('day', q.date, b.date)) AS days_apart,
    row_number() OVER (PARTITION BY _row_id ORDER BY abs(date_diff('day', q.date, b.date)), b.date, bank_id) AS nth
  FROM q JOIN bank b ON q.entity = b.entity AND round(q.amount * 100) = round(b.amount * 100) AND abs(date_diff('day', q.date, b.date)) <= 14)
SELECT q._row_id, bank_id AS bank_index, CAST(bank_date AS VARCHAR) AS bank_date, days_apart FROM q LEFT JOIN near ON near._row_id = q._row_id AND nth = 1""",
)
def nearest_bank_row(spark, sf_dir):
    """Every ledger row's nearest bank row, some ledger rows without a date or an amount."""
    rows = bank_ledger(spark, sf_dir)
    rows = rows.withColumns(
        {
            "date": F.when(F.length("memo") % 7 != 0, F.col("date")),
            "amount": F.when(F.length("name") % 5 != 0, F.col("amount")),
        }
    )
    found = ll.nearest_bank_row(rows, bank(spark, sf_dir), by="entity")
    return plain(found.select("_row_id", "bank_index", "bank_date", "days_apart"))


@query(
    "unmatched_ledger",
    f"""{matched_sql()} SELECT _row_id, entity, CAST(date AS VARCHAR) AS date, amount, name, memo, account
    FROM bank_ledger WHERE _row_id NOT IN (SELECT qb_index FROM matched)""",
)
def unmatched_ledger(spark, sf_dir):
    return plain(result(spark, sf_dir).unmatched_qb)


@query(
    "unmatched_bank",
    f"""{matched_sql()} SELECT bank_id, entity, CAST(date AS VARCHAR) AS date, amount, description
    FROM bank WHERE bank_id NOT IN (SELECT bank_index FROM matched)""",
)
def unmatched_bank(spark, sf_dir):
    return plain(result(spark, sf_dir).unmatched_bank)


@query(
    "reconcile_summary",
    f"""{matched_sql("entity")}, q AS (SELECT entity, count(*) AS n, sum(amount) AS s, count(*) FILTER (WHERE hit) AS m FROM
        (SELECT *, _row_id IN (SELECT qb_index FROM matched) AS hit FROM bank_ledger) GROUP BY entity),
      qs AS (SELECT entity, coalesce(sum(amount), 0) AS s FROM bank_ledger WHERE _row_id NOT IN (SELECT qb_index FROM matched) GROUP BY entity),
      bs AS (SELECT entity, count(*) AS n, coalesce(sum(amount), 0) AS s FROM bank WHERE bank_id NOT IN (SELECT bank_index FROM matched) GROUP BY entity)
    SELECT q.entity, q.m AS total_matched, coalesce(bs.n, 0) AS total_unmatched_bank, round(coalesce(bs.s, 0), 2) AS unmatched_bank_amount,
      q.n - q.m AS total_unmatched_qb, round(coalesce(qs.s, 0), 2) AS unmatched_qb_amount
    FROM q LEFT JOIN qs USING (entity) LEFT JOIN bs USING (entity)""",
)
def reconcile_summary(spark, sf_dir):
    _, summary = ll.reconcile_transactions(
        bank(spark, sf_dir), bank_ledger(spark, sf_dir), by="entity"
    )
    return plain(summary)


def jittered_bank(spark, sf_dir):
    """The register with amounts off by up to a cent and a half."""
    off = (F.day("date") % 7 - 3) * F.lit(0.005)
    return bank(spark, sf_dir).withColumn("amount", F.round(F.col("amount") + off, 3))


# Amounts lie near multiples of 500, far more than any tolerance apart, so that rows of the same
# multiple are the only possible partners. The fold then works as for the match to the cent.
SIGNED_SQL = f"""WITH {BANK},
jittered AS (SELECT * REPLACE (round(amount + (day(date) % 7 - 3) * 0.005, 3) AS amount) FROM bank),
takers AS (SELECT round(abs(amount) / 500) AS step,
    list({{'x': date_diff('day', DATE '1970-01-01', date), 'a': amount, 'picks': CAST([] AS BIGINT[])}} ORDER BY date, bank_id) AS wants,
    list(bank_id ORDER BY date, bank_id) AS ids FROM jittered GROUP BY ALL),
pool AS (SELECT round(abs(amount) / 500) AS step, list(date_diff('day', DATE '1970-01-01', date) ORDER BY date, _row_id) AS days,
    list(amount ORDER BY date, _row_id) AS amounts, list(_row_id ORDER BY date, _row_id) AS ids FROM bank_ledger GROUP BY ALL),
folded AS (SELECT q.ids AS taker_ids, b.ids AS pool_ids,
    list_reduce(q.wants, lambda done, w: {{'x': w.x, 'a': w.a, 'picks': list_append(done.picks, coalesce(
        list_min([CASE WHEN abs(b.days[i] - w.x) <= 14 AND NOT list_contains(done.picks, i) AND abs(b.amounts[i] - s * w.a) <= 0.01 + 0.00001 * abs(w.a)
                       THEN (CASE WHEN s = 1 THEN 0 ELSE 1 END) * 1000000000000 + abs(b.days[i] - w.x) * 1000000000 + i END
                  FOR i IN range(1, len(b.days) + 1) FOR s IN [1, -1]]) % 1000000000, 0))}},
      {{'x': CAST(0 AS BIGINT), 'a': CAST(0 AS DOUBLE), 'picks': CAST([] AS BIGINT[])}}).picks AS picks
  FROM takers q JOIN pool b USING (step)),
pairs AS (SELECT unnest(taker_ids) AS bank_index, unnest(picks) AS pick, pool_ids FROM folded),
matched AS (SELECT bank_index, pool_ids[pick] AS qb_index FROM pairs WHERE pick > 0)"""


def _signed_fold(sql: str) -> str:
    """DuckDB comprehensions take one loop: write the two signs out."""
    start = sql.index("list_min([CASE WHEN abs(b.days[i] - w.x) <= 14")
    end = sql.index("FOR s IN [1, -1]]) % 1000000000, 0)")
    terms = ", ".join(
        f"list_min([CASE WHEN abs(b.days[i] - w.x) <= 14 AND NOT list_contains(done.picks, i) AND abs(b.amounts[i] - {s} * w.a) <= 0.01 + 0.00001 * abs(w.a)"
        f" THEN {rank} * 1000000000000 + abs(b.days[i] - w.x) * 1000000000 + i END FOR i IN range(1, len(b.days) + 1)])"
        for rank, s in enumerate(("1", "(-1)"))
    )
    return sql[:start] + f"least({terms}) % 1000000000, 0)" + sql[end + len("FOR s IN [1, -1]]) % 1000000000, 0)") :]


SIGNED_SQL = _signed_fold(SIGNED_SQL)


def signed(spark, sf_dir, **options):
    return ll.match_bank_signed_tolerance(jittered_bank(spark, sf_dir), bank_ledger(spark, sf_dir), **options)


@query(
    "match_bank_signed_tolerance",
    f"""{SIGNED_SQL} SELECT bank_index, qb_index, CAST(b.date AS VARCHAR) AS bank_date, b.description AS bank_description, round(b.amount, 3) AS bank_amount,
      CAST(q.date AS VARCHAR) AS qb_date, q.amount AS qb_amount, name AS qb_name, '' AS qb_num
    FROM matched JOIN jittered b ON bank_index = bank_id JOIN bank_ledger q ON qb_index = _row_id""",
)
def match_bank_signed_tolerance(spark, sf_dir):
    return plain(signed(spark, sf_dir).matched, 3)


@query("match_bank_signed_in_blocks", f"{SIGNED_SQL} SELECT bank_index, qb_index FROM matched")
def match_bank_signed_in_blocks(spark, sf_dir):
    found = signed(spark, sf_dir, max_group_rows=100, block_rows=50)
    return found.matched.select("bank_index", "qb_index")


@query(
    "signed_reconcile_summary",
    f"""{SIGNED_SQL} SELECT (SELECT count(*) FROM matched) AS total_matched, b.n AS total_unmatched_bank, round(b.s, 3) AS unmatched_bank_amount,
      q.n AS total_unmatched_qb, round(q.s, 3) AS unmatched_qb_amount
    FROM (SELECT count(*) AS n, coalesce(sum(amount), 0) AS s FROM jittered WHERE bank_id NOT IN (SELECT bank_index FROM matched)) b,
         (SELECT count(*) AS n, coalesce(sum(amount), 0) AS s FROM bank_ledger WHERE _row_id NOT IN (SELECT qb_index FROM matched)) q""",
)
def signed_reconcile_summary(spark, sf_dir):
    return plain(ll.match_summary(signed(spark, sf_dir)), 3)


def dense_ledger(spark, sf_dir):
    """Bank rows with one of thirty amounts a cent apart, so that all of them hang together."""
    rows = ledger(spark, sf_dir).where(F.col("account_type") == "Bank")
    cents = F.round(F.col("amount") * 100).cast("bigint") % 30
    return rows.withColumn("amount", F.round(F.lit(100.0) + cents / 100, 2))


def dense_bank(spark, sf_dir):
    rows = dense_ledger(spark, sf_dir).where(F.length("memo") % 4 != 0)
    amount = F.round(F.col("amount") + (F.day("date") % 3 - 1) * F.lit(0.004), 3)
    return rows.select(
        F.col("_row_id").alias("bank_id"),
        F.date_add("date", F.day("date") % 19 - 4).alias("date"),
        F.when(F.month("date") % 6 == 0, -amount).otherwise(amount).alias("amount"),
    )


@query(
    "match_bank_signed_dense_cents",
    f"""WITH {LEDGER},
dense AS (SELECT _row_id, date, memo, round(100.0 + (CAST(round(amount * 100) AS BIGINT) % 30) / 100, 2) AS amount
  FROM ledger WHERE account_type = 'Bank'),
register AS (SELECT _row_id AS bank_id, date + CAST(day(date) % 19 - 4 AS INT) AS date,
    CASE WHEN month(date) % 6 = 0 THEN -1 ELSE 1 END * round(amount + (day(date) % 3 - 1) * 0.004, 3) AS amount
  FROM dense WHERE length(memo) % 4 <> 0),
pool AS (SELECT *, row_number() OVER (ORDER BY date, _row_id) AS place FROM dense),
offers AS (SELECT bank_id, p.place, s.sign, abs(date_diff('day', p.date, b.date)) AS gap
  FROM register b JOIN pool p ON p.date BETWEEN b.date - 14 AND b.date + 14, (VALUES (1), (-1)) s(sign)
  WHERE abs(p.amount - s.sign * b.amount) <= 0.01 + 0.00001 * abs(b.amount)),
wants AS (SELECT b.bank_id, any_value(b.date) AS date, coalesce(list(o.place ORDER BY o.sign DESC, gap, o.place) FILTER (o.place IS NOT NULL), []) AS choice
  FROM register b LEFT JOIN offers o USING (bank_id) GROUP BY b.bank_id),
lined AS (SELECT list(bank_id ORDER BY date, bank_id) AS ids,
    list({{'choice': choice, 'picks': CAST([] AS BIGINT[])}} ORDER BY date, bank_id) AS wants FROM wants),
folded AS (SELECT ids, list_reduce(list_concat([{{'choice': CAST([] AS BIGINT[]), 'picks': CAST([] AS BIGINT[])}}], wants),
    lambda done, w: {{'choice': CAST([] AS BIGINT[]), 'picks': list_append(done.picks,
      coalesce(list_filter(w.choice, lambda c: NOT list_contains(done.picks, c))[1], 0))}}).picks AS picks FROM lined),
found AS (SELECT unnest(ids) AS bank_index, unnest(picks) AS place FROM folded)
SELECT bank_index, _row_id AS qb_index FROM found JOIN pool USING (place)""",
)
def match_bank_signed_dense_cents(spark, sf_dir):
    """Amounts within tolerance of each other without end: served in stretches of time and ranges of amounts."""
    found = ll.match_bank_signed_tolerance(
        dense_bank(spark, sf_dir), dense_ledger(spark, sf_dir), max_group_rows=2000, block_rows=500
    )
    return found.matched.select("bank_index", "qb_index")


INSIDE = f"date BETWEEN DATE '{START}' AND DATE '{END}'"

CASH_SQL = f"""cash AS (SELECT entity, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS revenue_cash,
    abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS expenses_cash FROM bank WHERE {INSIDE} GROUP BY entity)"""

ACCRUAL_SQL = f"""accrual AS (SELECT entity, 0 - coalesce(sum(amount) FILTER (WHERE account_type ILIKE '%income%'), 0) AS revenue_accrual,
    abs(coalesce(sum(amount) FILTER (WHERE account_type ILIKE '%cost of goods sold%'), 0))
    + abs(coalesce(sum(amount) FILTER (WHERE account_type ILIKE '%expense%' AND NOT account_type ILIKE '%income%'), 0)) AS expenses_accrual
    FROM ledger WHERE {INSIDE} GROUP BY entity)"""


@query(
    "cash_basis_pl",
    f"""WITH {BANK}, {CASH_SQL} SELECT entity, round(revenue_cash, 2) AS revenue_cash, round(expenses_cash, 2) AS expenses_cash,
      round(revenue_cash - expenses_cash, 2) AS net_cash FROM cash""",
)
def cash_basis_pl(spark, sf_dir):
    return plain(ll.compute_cash_basis_pl(bank(spark, sf_dir), START, END, by="entity"))


@query(
    "accrual_pl",
    f"""WITH {LEDGER}, {ACCRUAL_SQL} SELECT entity, round(revenue_accrual, 2) AS revenue_accrual, round(expenses_accrual, 2) AS expenses_accrual,
      round(revenue_accrual - expenses_accrual, 2) AS net_accrual FROM accrual""",
)
def accrual_pl(spark, sf_dir):
    return plain(ll.compute_accrual_pl_from_qb(ledger(spark, sf_dir), START, END, by="entity"))


@query(
    "cash_vs_accrual",
    f"""WITH {BANK}, {CASH_SQL}, {ACCRUAL_SQL} SELECT entity, round(revenue_cash, 2) AS revenue_cash, round(expenses_cash, 2) AS expenses_cash,
      round(revenue_cash - expenses_cash, 2) AS net_cash, round(revenue_accrual, 2) AS revenue_accrual, round(expenses_accrual, 2) AS expenses_accrual,
      round(revenue_accrual - expenses_accrual, 2) AS net_accrual, round(revenue_accrual - revenue_cash, 2) AS revenue_diff,
      round(expenses_accrual - expenses_cash, 2) AS expenses_diff,
      round(revenue_accrual - expenses_accrual - (revenue_cash - expenses_cash), 2) AS net_diff FROM cash JOIN accrual USING (entity)""",
)
def cash_vs_accrual(spark, sf_dir):
    return plain(
        ll.compute_cash_vs_accrual_summary(
            ledger(spark, sf_dir), bank(spark, sf_dir), START, END, by="entity"
        )
    )
