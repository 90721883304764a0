"""Catalog, history, ledger and merge operators: functions from DataFrames to DataFrames."""
