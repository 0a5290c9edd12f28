"""Driftwell: move, reconcile and audit tabular data with Spark DataFrames."""
