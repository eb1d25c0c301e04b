"""Temporal analytics operators on PySpark DataFrames."""
