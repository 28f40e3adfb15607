"""Ambient-telemetry analytics on Spark: DataFrames in, DataFrames out."""
