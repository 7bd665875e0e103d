"""Schemas and keys of the stored tables."""

from __future__ import annotations

PRICES = "stock string, date date, price double, ingested_at timestamp"
EARNINGS = "stock string, earnings_date date, fiscal_end_date date, reported_eps double, estimated_eps double, surprise_percentage double, ingested_at timestamp"
STOCK_DATA = "stock string, company_name string, sector string, sub_sector string, status string, reason string, ingested_at timestamp"
EPS_ESTIMATES = (
    "stock string, snapshot_date date, earnings_date date, eps_avg double, eps_high double, eps_low double, eps_num_analysts int, eps_dispersion double, "
    "eps_trend_7d double, eps_trend_30d double, eps_trend_60d double, eps_trend_90d double, eps_revision_momentum double, "
    "eps_revisions_up_7d int, eps_revisions_up_30d int, eps_revisions_down_7d int, eps_revisions_down_30d int, "
    "revenue_avg double, revenue_high double, revenue_low double, ingested_at timestamp"
)
IV_SNAPSHOTS = (
    "stock string, snapshot_date date, snapshot_hour int, earnings_date date, days_to_earnings int, current_price double, expiry_used date, "
    "atm_strike double, atm_call_iv double, atm_put_iv double, atm_iv double, expected_move_pct double, ingested_at timestamp"
)
KEYS = {
    "prices": ("stock", "date"),
    "earnings": ("stock", "earnings_date", "fiscal_end_date"),
    "stock_data": ("stock",),
    "eps_estimates": ("stock", "snapshot_date"),
    "iv_snapshots": ("stock", "snapshot_date", "snapshot_hour"),
}
SCHEMAS = {"prices": PRICES, "earnings": EARNINGS, "stock_data": STOCK_DATA, "eps_estimates": EPS_ESTIMATES, "iv_snapshots": IV_SNAPSHOTS}
