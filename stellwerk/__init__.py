"""Spark-first pipeline and query library for job-market data."""
