"""Batch analytics operators for PySpark DataFrames."""
