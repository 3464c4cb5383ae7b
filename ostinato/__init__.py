"""Rhythm analytics for large collections of time series, on Spark."""
