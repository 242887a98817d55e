"""Parafold: order-aware text, table and series processing on Spark DataFrames."""
