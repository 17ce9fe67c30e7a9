"""Period metrics, monthly tables, run rates, projections, dashboards, invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

import ledgerlake as ll

from .core import (
    CLASSIFIED,
    CUT_OVER,
    FLAGGED,
    FLAGGED_PLAIN,
    PERIOD_START,
    TODAY,
    YEAR_END,
    addbacks,
    ledger,
    period_cte,
    plain,
    query,
    rounded,
    size,
    table,
    two_decimals,
)
from .ledger_queries import ADDBACK_ACCOUNTS, flagged

# The measures' names.
PERIOD = (
    "revenue", "cogs", "overhead", "other_expense", "gross_profit", "net_profit", "addbacks", "sde",
)
LEGACY = ("legacy_july_total_expense", "legacy_july_excluded_job_cost", "legacy_july_included_overhead")
OWNER = (*PERIOD, "legacy_cogs", *LEGACY)
KPIS = (*PERIOD, "legacy_cogs")

IN_PERIOD = f"date BETWEEN DATE '{PERIOD_START}' AND DATE '{TODAY}'"
IN_REPORT = f"date BETWEEN DATE '{CUT_OVER}' AND DATE '{TODAY}'"
IN_LEGACY = "date BETWEEN DATE '1998-07-01' AND DATE '1998-07-31'"
JOB = "coalesce(substr(account, 1, 3) IN ('704', '705', '706', '707', '708'), false)"
SPENT = "(is_overhead OR is_other_expense OR is_cogs)"


def owner_cte(where: str, overrides: str = "false", by: str = "", cut_over: str = CUT_OVER) -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    after, earlier = f"date >= DATE '{cut_over}'", f"date < DATE '{cut_over}'"
    return f"""owner_sums AS (
SELECT {lead}min(date) AS first_date,
  {size(f"is_revenue AND {after}")} AS revenue, {size(f"is_cogs AND {after}")} AS cogs,
  {size(f"is_cogs AND {earlier}")} AS legacy_cogs, {size(f"is_overhead AND {after}")} AS overhead,
  {size(f"is_other_expense AND {after}")} AS other_expense, {addbacks(f"sde_addback_flag OR {overrides}")} AS addbacks,
  {size(f"{SPENT} AND {earlier}")} AS legacy_july_total_expense,
  {size(f"{SPENT} AND {earlier} AND {JOB}")} AS legacy_july_excluded_job_cost,
  {size(f"is_overhead AND {earlier} AND NOT {JOB}")} AS legacy_july_included_overhead
FROM flagged WHERE {where} {group}),
owner AS (SELECT *, revenue - cogs AS gross_profit, revenue - (cogs + overhead + other_expense) AS net_profit,
  revenue - (cogs + overhead + other_expense) + addbacks AS sde FROM owner_sums)"""


@query("owner_metrics", f"WITH {FLAGGED}, {owner_cte(IN_PERIOD)} SELECT {rounded(OWNER)} FROM owner")
def owner_metrics(spark, sf_dir):
    return plain(ll.get_owner_metrics(flagged(spark, sf_dir), PERIOD_START, TODAY, CUT_OVER))


@query(
    "owner_metrics_by_entity",
    f"""WITH {FLAGGED}, {owner_cte(IN_PERIOD, f"account IN {ADDBACK_ACCOUNTS}", "entity")}
    SELECT entity, {rounded(OWNER)} FROM owner""",
)
def owner_metrics_by_entity(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    return plain(
        ll.get_owner_metrics(
            rows, PERIOD_START, TODAY, CUT_OVER, addback_account_overrides=ADDBACK_ACCOUNTS, by="entity"
        )
    )


@query(
    "period_metrics",
    f"WITH {FLAGGED}, {period_cte('period', f'is_pnl AND {IN_REPORT}')} SELECT {rounded(PERIOD)} FROM period",
)
def period_metrics(spark, sf_dir):
    return plain(ll.get_period_metrics(ll.report_window(flagged(spark, sf_dir), CUT_OVER, TODAY)))


@query(
    "period_metrics_by_entity",
    f"WITH {FLAGGED}, {period_cte('period', 'is_pnl', 'entity')} SELECT entity, {rounded(PERIOD)} FROM period",
)
def period_metrics_by_entity(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    return plain(ll.get_period_metrics(rows.where("is_pnl"), by="entity"))


def kpi_cte(name: str, start: str, by: str = "") -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    inside = f"date BETWEEN DATE '{start}' AND DATE '{TODAY}'"
    after, earlier = f"date >= DATE '{CUT_OVER}'", f"date < DATE '{CUT_OVER}'"
    return f"""{name}_sums AS (
SELECT {lead}{size(f"is_revenue AND {after}")} AS revenue, {size(f"is_cogs AND {after}")} AS cogs,
  {size(f"is_cogs AND {earlier}")} AS legacy_cogs, {size("is_overhead")} AS overhead,
  {size("is_other_expense")} AS other_expense, {addbacks("sde_addback_flag")} AS addbacks
FROM flagged WHERE {inside} {group}),
{name} AS (SELECT *, revenue - cogs AS gross_profit, revenue - (cogs + overhead + other_expense) AS net_profit,
  revenue - (cogs + overhead + other_expense) + addbacks AS sde FROM {name}_sums)"""


KPI_SQL = f"WITH {FLAGGED_PLAIN}, {kpi_cte('owner_period', PERIOD_START, 'entity')}, {kpi_cte('run_rate', CUT_OVER, 'entity')}"


@query(
    "period_kpis",
    f"""{KPI_SQL} SELECT entity, 'owner_period' AS period, {rounded(KPIS)} FROM owner_period
    UNION ALL SELECT entity, 'run_rate_period' AS period, {rounded(KPIS)} FROM run_rate""",
)
def period_kpis(spark, sf_dir):
    return plain(ll.kpi_periods(ledger(spark, sf_dir), TODAY, PERIOD_START, CUT_OVER, by="entity"))


@query(
    "kpis_of_one_period",
    f"WITH {FLAGGED_PLAIN}, {kpi_cte('kpis', PERIOD_START)} SELECT {rounded(KPIS)} FROM kpis",
)
def kpis_of_one_period(spark, sf_dir):
    return plain(ll.compute_period_kpis(ledger(spark, sf_dir), PERIOD_START, TODAY, CUT_OVER))


@query(
    "kpi_report",
    f"""{KPI_SQL} SELECT entity, '{TODAY}' AS as_of, 183 AS owner_period_days, 152 AS run_rate_period_days,
    round(o.legacy_cogs, 2) AS july_legacy_cogs_excluded, round(o.sde, 2) AS owner_sde, round(r.sde, 2) AS run_rate_sde
    FROM owner_period o JOIN run_rate r USING (entity)""",
)
def kpi_report(spark, sf_dir):
    record = ll.kpi_report(ledger(spark, sf_dir), TODAY, PERIOD_START, CUT_OVER, by="entity")
    return plain(
        record.select(
            "entity",
            F.col("metadata.current_date").alias("as_of"),
            "summary.owner_period_days",
            "summary.run_rate_period_days",
            "summary.july_legacy_cogs_excluded",
            F.col("owner_period.sde").alias("owner_sde"),
            F.col("run_rate_period.sde").alias("run_rate_sde"),
        )
    )


@query(
    "legacy_overhead_candidates",
    f"""WITH {CLASSIFIED} SELECT _row_id, CAST(date AS VARCHAR) AS date, account, name, memo, round(amount, 2) AS amount
    FROM classified WHERE {IN_LEGACY} AND is_overhead AND is_pnl""",
)
def legacy_overhead_candidates(spark, sf_dir):
    return plain(ll.legacy_overhead_candidates(flagged(spark, sf_dir), CUT_OVER))


# The user's choice of rows: those on an account that ends in LARGE.
CHOSEN = "account LIKE '%LARGE'"


@query(
    "legacy_overhead_by_entity",
    f"""WITH {CLASSIFIED} SELECT entity, round({size(CHOSEN)}, 2) AS legacy_overhead
    FROM classified WHERE {IN_LEGACY} AND is_overhead AND {CHOSEN} GROUP BY entity""",
)
def legacy_overhead_by_entity(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    chosen = rows.where(CHOSEN).select("_row_id")
    return plain(
        ll.compute_legacy_overhead_addins(
            rows, "1998-07-01", "1998-07-31", included_row_ids=chosen, by="entity"
        )
    )


BRIDGE_STEPS = ("Net profit", "Less: legacy overhead add-ins", "Net profit (adjusted)")


@query(
    "legacy_overhead_addins",
    f"""WITH {FLAGGED}, {period_cte("period", f"is_pnl AND {IN_REPORT}")},
    addin AS (SELECT {size("true")} AS t FROM flagged WHERE {IN_LEGACY} AND is_overhead AND account IN {ADDBACK_ACCOUNTS})
    SELECT 1 AS position, '{BRIDGE_STEPS[0]}' AS step, round(net_profit, 2) AS amount FROM period
    UNION ALL SELECT 2, '{BRIDGE_STEPS[1]}', round(0 - t, 2) FROM addin
    UNION ALL SELECT 3, '{BRIDGE_STEPS[2]}', round(net_profit - t, 2) FROM period, addin""",
)
def legacy_overhead_addins(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    addin = ll.compute_legacy_overhead_addins(rows, "1998-07-01", "1998-07-31", ADDBACK_ACCOUNTS)
    metrics = ll.get_period_metrics(ll.report_window(rows, CUT_OVER, TODAY))
    adjusted = ll.apply_legacy_overhead_addins(
        metrics.withColumn("qb_net_profit", F.col("net_profit")), addin
    )
    return plain(ll.reconciliation_bridge(adjusted, BRIDGE_STEPS))


def monthly_cte(by: str = "", where: str = "true", cut_over: str = CUT_OVER) -> str:
    lead = f"{by}, " if by else ""
    window = f"OVER (PARTITION BY {by} ORDER BY month)" if by else "OVER (ORDER BY month)"

    def line(label: str) -> str:
        counted = f"CASE WHEN is_revenue AND date < DATE '{cut_over}' THEN 0 ELSE amount END"
        return f"abs(coalesce(sum({counted}) FILTER (WHERE classification = '{label}'), 0))"

    mom = ", ".join(
        f"{m} - lag({m}) {window} AS {m}_mom_delta, ({m} - lag({m}) {window}) / nullif(lag({m}) {window}, 0) AS {m}_mom_pct"
        for m in ("revenue", "net_profit", "sde")
    )
    return f"""month_sums AS (
SELECT {lead}CAST(date_trunc('month', date) AS DATE) AS month, {line("Revenue")} AS revenue, {line("COGS")} AS cogs,
  {line("Overhead")} AS overhead, {line("Other")} AS other_expense,
  coalesce(sum(abs(amount)) FILTER (WHERE sde_addback_flag), 0) AS addbacks
FROM flagged WHERE {where} GROUP BY ALL),
months AS (SELECT *, revenue - cogs AS gross_profit, revenue - cogs - overhead - other_expense AS net_profit,
  revenue - cogs - overhead - other_expense + addbacks AS sde FROM month_sums),
monthly AS (SELECT *, strftime(month, '%b %Y') AS month_str, gross_profit / nullif(revenue, 0) AS gross_margin_pct,
  net_profit / nullif(revenue, 0) AS net_margin_pct, sde / nullif(revenue, 0) AS sde_margin_pct,
  overhead / nullif(revenue, 0) AS overhead_pct, cogs / nullif(revenue, 0) AS cogs_pct, {mom} FROM months)"""


MONEY = (
    "revenue", "cogs", "overhead", "other_expense", "gross_profit", "net_profit", "addbacks", "sde",
    "revenue_mom_delta", "net_profit_mom_delta", "sde_mom_delta",
)
RATIOS = (
    "gross_margin_pct", "net_margin_pct", "sde_margin_pct", "overhead_pct", "cogs_pct",
    "revenue_mom_pct", "net_profit_mom_pct", "sde_mom_pct",
)
MONTH = "CAST(month AS VARCHAR) AS month, month_str"


def plain_months(df):
    """Money to cents, ratios to six digits."""
    return plain(df.withColumns({c: F.round(c, 2) for c in MONEY}), 6)


@query(
    "monthly_kpis",
    f"WITH {FLAGGED}, {monthly_cte()} SELECT {MONTH}, {rounded(MONEY)}, {rounded(RATIOS, 6)} FROM monthly",
)
def monthly_kpis(spark, sf_dir):
    return plain_months(ll.compute_monthly_kpis(flagged(spark, sf_dir), CUT_OVER))


@query(
    "monthly_kpis_by_entity",
    f"""WITH {FLAGGED}, {monthly_cte("entity", cut_over="1996-01-01")}
    SELECT entity, {MONTH}, {rounded(MONEY)}, {rounded(RATIOS, 6)} FROM monthly""",
)
def monthly_kpis_by_entity(spark, sf_dir):
    return plain_months(ll.compute_monthly_kpis(flagged(spark, sf_dir), "1996-01-01", by="entity"))


@query(
    "addbacks_by_month",
    f"""WITH {FLAGGED} SELECT entity, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month,
      strftime(date_trunc('month', date), '%b %Y') AS month_str, round(sum(abs(amount)), 2) AS addbacks, count(*) AS "count"
    FROM flagged WHERE sde_addback_flag GROUP BY ALL""",
)
def addbacks_by_month(spark, sf_dir):
    return plain(ll.addbacks_by_month(flagged(spark, sf_dir), by="entity"))


REPORT_MONTHS = f"WITH {FLAGGED}, {monthly_cte(where=f'is_pnl AND {IN_REPORT}')}"


def report_months(spark, sf_dir):
    return ll.dashboard_months(flagged(spark, sf_dir), CUT_OVER, TODAY)


@query(
    "monthly_summary",
    f"""{REPORT_MONTHS} SELECT month_str AS "Month", {rounded(("revenue", "cogs", "overhead", "other_expense", "net_profit", "addbacks", "sde"))}
    FROM monthly WHERE month >= DATE '{CUT_OVER}'""",
)
def monthly_summary(spark, sf_dir):
    return plain(ll.monthly_summary(report_months(spark, sf_dir)))


@query(
    "margin_view",
    f"""{REPORT_MONTHS} SELECT month_str, round(net_margin_pct, 6) AS "Net Margin %", round(sde_margin_pct, 6) AS "SDE Margin %" FROM monthly""",
)
def margin_view(spark, sf_dir):
    return plain(ll.margin_view(report_months(spark, sf_dir)), 6)


@query("chart_series", f"{REPORT_MONTHS} SELECT month_str, {rounded(('revenue', 'net_profit', 'sde'))} FROM monthly")
def chart_series(spark, sf_dir):
    return plain(ll.chart_series(report_months(spark, sf_dir)))


ELAPSED, LEFT = 152, 181


THIRD = "1 / 3.0"


def plain_outlook(df, columns=()):
    """Rates and projections in whole units, a third added before rounding.

    Cents times 487/2432 or 333/152 can end in exactly half a unit, where rounding would hang on
    the last bit of a sum. With a third on top they never do.
    """
    wide = [c for c in df.columns if c in columns or c.startswith(("monthly_", "proj_"))]
    return plain(df.withColumns({c: F.round(F.col(c) + F.lit(1 / 3), 0) for c in wide}))


@query(
    "run_rates",
    f"""WITH {FLAGGED}, {period_cte("period", f"is_pnl AND {IN_REPORT}", "entity")}
    SELECT entity, {", ".join(f"round({c} / {ELAPSED} * 30.4375 + {THIRD}, 0) AS {c}" for c in PERIOD)} FROM period""",
)
def run_rates(spark, sf_dir):
    metrics = ll.get_period_metrics(
        ll.report_window(flagged(spark, sf_dir), CUT_OVER, TODAY), by="entity"
    )
    rates = ll.calculate_run_rates(metrics, ll.days_between(CUT_OVER, TODAY), by="entity")
    return plain_outlook(rates, columns=PERIOD)


def projection(columns, actual: str = "o.", rate: str = "r.") -> str:
    def one(c: str) -> str:
        if c == "gross_profit":
            return f"({one('revenue')} - {one('cogs')})"
        if c not in PERIOD:
            return f"{actual}{c}"
        return f"({actual}{c} + {rate}{c} / {ELAPSED}.0 * {LEFT})"

    return ", ".join(f"round({one(c)} + {THIRD}, 0) AS {c}" for c in columns)


@query(
    "forecast",
    f"""WITH {FLAGGED}, {owner_cte(IN_PERIOD, by="entity")}, {period_cte("period", f"is_pnl AND {IN_REPORT}", "entity")}
    SELECT o.entity, {projection(OWNER)}, round({LEFT} / 30.4375, 2) AS months_remaining
    FROM owner o JOIN period r ON o.entity = r.entity""",
)
def forecast(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    owner = ll.get_owner_metrics(rows, PERIOD_START, TODAY, CUT_OVER, by="entity")
    period = ll.get_period_metrics(ll.report_window(rows, CUT_OVER, TODAY), by="entity")
    rates = ll.calculate_run_rates(period, ll.days_between(CUT_OVER, TODAY), by="entity")
    outlook = ll.forecast_year_1(owner, rates, ll.days_between(TODAY, YEAR_END), by="entity")
    return plain_outlook(outlook, columns=OWNER)


@query(
    "financial_analysis",
    f"""WITH {FLAGGED_PLAIN}, {owner_cte(f"date <= DATE '{TODAY}'", by="entity")}, {period_cte("period", IN_REPORT, "entity")}
    SELECT o.entity, CAST(o.first_date AS VARCHAR) AS owner_period_start, {rounded(OWNER, prefix="o.")},
      {", ".join(f"round(r.{c} / {ELAPSED} * 30.4375 + {THIRD}, 0) AS monthly_{c}" for c in PERIOD)},
      {projection(OWNER).replace(" AS ", " AS proj_")}
    FROM owner o JOIN period r ON o.entity = r.entity""",
)
def financial_analysis(spark, sf_dir):
    outlook = ll.financial_analysis(ledger(spark, sf_dir), TODAY, CUT_OVER, YEAR_END, by="entity")
    return plain_outlook(outlook)


DASHBOARD_RULES = [{"name": "big_bolts", "memo_contains": "bolt", "amount": 60000, "amount_tolerance": 20000}]

DASHBOARD_SQL = f"""WITH {FLAGGED}, ruled AS (SELECT * REPLACE (
    sde_addback_flag OR (contains(memo, 'bolt') AND abs(abs(amount) - 60000) <= 20000) AS sde_addback_flag) FROM flagged),
  {period_cte("period", f"is_pnl AND {IN_REPORT}", "entity", "ruled")},
  addin AS (SELECT entity, {size("true")} AS t, count(*) AS n FROM ruled WHERE {IN_LEGACY} AND is_overhead AND {CHOSEN} GROUP BY entity),
  both_sides AS (SELECT p.*, coalesce(t, 0) AS t, coalesce(n, 0) AS n FROM period p LEFT JOIN addin USING (entity))"""


def dashboard(spark, sf_dir):
    rows = ll.flagged_ledger(ledger(spark, sf_dir), None, ("ring", "gear"), DASHBOARD_RULES)
    chosen = ledger(spark, sf_dir).where(CHOSEN).select("_row_id")
    return ll.dashboard_metrics(rows, CUT_OVER, TODAY, YEAR_END, chosen, by="entity")


@query(
    "dashboard_metrics",
    f"""{DASHBOARD_SQL} SELECT entity, {rounded(PERIOD)}, round(t, 2) AS legacy_overhead_included, n AS legacy_overhead_rows,
      round(overhead + t, 2) AS adjusted_overhead, round(net_profit - t, 2) AS adjusted_net_profit, round(sde - t, 2) AS adjusted_sde,
      {", ".join(f"round({c} / {ELAPSED} * 30.4375 + {THIRD}, 0) AS monthly_{c}" for c in PERIOD)},
      {", ".join(f"round({c} {adj} + {c} / {ELAPSED}.0 * {LEFT} + {THIRD}, 0) AS proj_{c}" for c, adj in [(c, "+ t" if c == "overhead" else "- t" if c in ("net_profit", "sde") else "") for c in PERIOD])}
    FROM both_sides""",
)
def dashboard_metrics(spark, sf_dir):
    return plain_outlook(dashboard(spark, sf_dir))


@query(
    "dashboard_payload",
    f"""{DASHBOARD_SQL} SELECT entity, '{CUT_OVER}' AS report_start, '1998-07-31' AS legacy_end, '704,705,706,707,708' AS cogs_prefixes,
      n AS july_overhead_selected_count, round(sde - t, 2) AS ytd_sde, round(net_profit - t + net_profit / {ELAPSED}.0 * {LEFT} + {THIRD}, 0) AS proj_net,
      round(net_profit, 2) AS qb_net_start_plus, round(t, 2) AS legacy_overhead_included,
      round(revenue / {ELAPSED} * 30.4375 + {THIRD}, 0) AS monthly_revenue FROM both_sides""",
)
def dashboard_payload(spark, sf_dir):
    record = ll.dashboard_payload(dashboard(spark, sf_dir), CUT_OVER, TODAY, YEAR_END, by="entity")
    return plain_outlook(
        record.select(
            "entity",
            "payload.config.report_start",
            F.col("payload.config.july_overhead_window.end").alias("legacy_end"),
            F.array_join("payload.config.cogs_prefixes", ",").alias("cogs_prefixes"),
            "payload.config.july_overhead_selected_count",
            "payload.dashboard_metrics.ytd_sde",
            "payload.dashboard_metrics.proj_net",
            "payload.reconciliation_bridge.qb_net_start_plus",
            "payload.reconciliation_bridge.legacy_overhead_included",
            "payload.run_rates.monthly_revenue",
        )
    )


def raw_job_costs(spark, sf_dir):
    lines, orders, customers = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    kind = F.get(
        F.array(*[F.lit(k) for k in (" Material", "LABOR", "supervision ", "permit")]),
        (F.col("l_linenumber") % 4).cast("int"),
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("JOB-"), F.col("c_nationkey").cast("string")).alias("Project"),
            F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"),
            F.col("c_name").alias("Name"),
            two_decimals("l_extendedprice").alias("Total"),
            kind.alias("Cost Type"),
            F.col("o_orderpriority").alias("Memo"),
        )
    )


JOB_COSTS = """costs AS (
SELECT concat('JOB-', CAST(c_nationkey AS VARCHAR)) AS job, CAST(o_orderdate AS DATE) AS date,
  c_name AS vendor_or_employee, l_extendedprice AS amount, o_orderpriority AS description,
  CASE l_linenumber % 4 WHEN 0 THEN 'material' WHEN 1 THEN 'labor' WHEN 2 THEN 'supervision' ELSE 'permit' END AS cost_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(
    "green_sheets",
    f"""WITH {JOB_COSTS} SELECT job, CAST(date AS VARCHAR) || ' 00:00:00' AS date, vendor_or_employee, description,
    round(amount, 2) AS amount, cost_type, CAST(NULL AS VARCHAR) AS sov_line, CAST(NULL AS VARCHAR) AS ref FROM costs""",
)
def green_sheets(spark, sf_dir):
    return plain(ll.load_green_sheets(raw_job_costs(spark, sf_dir)))


@query(
    "job_billing",
    f"""WITH {JOB_COSTS}, config AS (SELECT concat('JOB-', CAST(n_nationkey + 2 AS VARCHAR)) AS job,
      CAST(0.05 + (n_nationkey % 5) * 0.01 AS DOUBLE) AS overhead_pct, CAST(0.03 + (n_nationkey % 3) * 0.01 AS DOUBLE) AS profit_pct FROM nation),
    sums AS (SELECT job, sum(amount) FILTER (WHERE cost_type = 'material') AS m, sum(amount) FILTER (WHERE cost_type = 'labor') AS l,
      sum(amount) FILTER (WHERE cost_type = 'supervision') AS s FROM costs WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY job),
    base AS (SELECT config.*, round_even(coalesce(m, 0.0) * 100, 0) / 100 AS materials, round_even(coalesce(l, 0.0) * 100, 0) / 100 AS labor,
      round_even(coalesce(s, 0.0) * 100, 0) / 100 AS supervision FROM config LEFT JOIN sums USING (job)),
    oh AS (SELECT *, materials + labor + supervision AS b, round_even((materials + labor + supervision) * overhead_pct * 100, 0) / 100 AS overhead_amount FROM base),
    pr AS (SELECT *, round_even((b + overhead_amount) * profit_pct * 100, 0) / 100 AS profit_amount FROM oh)
    SELECT job, '1997-01-01 → 1997-12-31' AS period, {rounded(("materials", "labor", "supervision", "overhead_pct", "profit_pct", "overhead_amount", "profit_amount"))},
      round(b + overhead_amount + profit_amount, 2) AS invoice_total FROM pr""",
)
def job_billing(spark, sf_dir):
    configs = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("JOB-"), (F.col("n_nationkey") + 2).cast("string")).alias("job"),
        F.expr("CAST(0.05 + (n_nationkey % 5) * 0.01 AS DOUBLE)").alias("overhead_pct"),
        F.expr("CAST(0.03 + (n_nationkey % 3) * 0.01 AS DOUBLE)").alias("profit_pct"),
    )
    costs = ll.load_green_sheets(raw_job_costs(spark, sf_dir))
    return plain(ll.compute_period_billing(costs, configs, "1997-01-01", "1997-12-31"))
