"""Spark-first analog forecasting, signal evaluation and corpus preparation."""
