"""General-ledger analytics as Spark DataFrame operations."""

from .functions import *  # noqa: F403
from .operators.accounts import build_account_summary
from .operators.addbacks import (
    apply_addback_rules,
    apply_rule_table,
    apply_rules_to_df,
    detect_addbacks,
)
from .operators.billing import JobBillingConfig, compute_job_invoice, compute_period_billing
from .operators.cash import (
    compute_accrual_pl_from_qb,
    compute_cash_basis_pl,
    compute_cash_vs_accrual_summary,
)
from .operators.classify import classify_transactions
from .operators.display import redact_text, render_dates
from .operators.matching import (
    MatchResult,
    match_bank_signed_tolerance,
    match_qb_and_bank,
    match_summary,
    reconcile_transactions,
)
from .operators.metrics import (
    apply_legacy_overhead_addins,
    calculate_run_rates,
    compute_legacy_overhead_addins,
    compute_period_kpis,
    forecast_year_1,
    get_owner_metrics,
    get_period_metrics,
    legacy_overhead_candidates,
    reconciliation_bridge,
)
from .operators.monthly import (
    addbacks_by_month,
    chart_series,
    compute_monthly_kpis,
    margin_view,
    monthly_summary,
    months_from,
)
from .operators.nearest import nearest_bank_row, nearest_rows
from .operators.profile import (
    addback_listing,
    addback_totals,
    distinct_accounts,
    ledger_totals,
    non_null_counts,
    preview,
    value_counts,
)
from .plans.analysis import financial_analysis
from .plans.dashboard import (
    dashboard_metrics,
    dashboard_months,
    dashboard_payload,
    flagged_ledger,
    report_window,
    write_json,
)
from .plans.kpi_report import kpi_periods, kpi_report
from .plans.reconcile import Reconciliation, reconcile_exports, reconcile_ledger
from .sources import *  # noqa: F403
