"""Prismlake: hyperspectral target and anomaly detection on Spark DataFrames."""
