"""Relational-graph analytics on PySpark DataFrames."""
