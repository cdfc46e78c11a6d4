"""Quarryline: retrieval, corpus and evaluation analytics on PySpark DataFrames."""
