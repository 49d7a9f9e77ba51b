"""Hybrid retrieval analytics on PySpark: corpus building, search, segments and per-user state as DataFrames."""
