"""Bulk operators: functions from DataFrames to DataFrames, keyed by explicit columns and an explicit order."""
