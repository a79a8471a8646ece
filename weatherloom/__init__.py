"""Seasonal analysis, anomaly detection and monitoring of per-city readings on Spark.

Every operator takes DataFrames and returns a DataFrame that covers all cities at once.
"""
