"""Tidemark: schedule, transcript and telemetry analytics on Spark DataFrames."""
