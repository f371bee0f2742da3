"""Profiling, generation and validation of tabular and longitudinal data on Spark."""
