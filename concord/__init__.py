"""Reconciliation of two datasets on Spark: differences, rechecks and reports as DataFrames."""
