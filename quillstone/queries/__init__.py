"""Queries by family, each with its SQL for DuckDB where SQL can express it."""
