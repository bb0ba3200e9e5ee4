"""Streaming-SQL analytics on Spark: operators, functions, a SQL dialect, change-logs and connectors."""
