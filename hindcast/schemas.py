"""Explicit schemas of the engine's tables (DDL strings); nothing is inferred."""

BARS = "symbol string, session_date date, open double, high double, low double, close double, volume double, updated_at timestamp"
CONTEXT = "session_date date, market double, vix double"
LEDGER = (
    "symbol string, as_of_date date, horizon_days int, horizon_date date, status string, probability_up double, calibrated_probability_up double, "
    "baseline_up_rate double, direction string, side string, tier string, eligible boolean, universe_id int, model_version string, data_vintage string, "
    "scan_run_id long, created_at timestamp, entry_date date, outcome_date date, realized_return double"
)
LISTING = "symbol string, name string, market_category string, test_issue string, financial_status string, round_lot int, etf string, next_shares string"
OTHER_LISTING = "act_symbol string, name string, exchange string, cqs_symbol string, etf string, round_lot int, test_issue string, nasdaq_symbol string"
SHORT_INTEREST = "symbol string, settlement_date date, short_shares double, previous_short_shares double, avg_daily_volume double, days_to_cover double, change_percent double"
