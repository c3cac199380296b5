"""Parallel-corpus preparation and analysis as Spark DataFrame jobs."""
