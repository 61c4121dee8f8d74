"""Spark-native analytics for per-string photovoltaic time series."""
