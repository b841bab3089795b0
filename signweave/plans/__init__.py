"""Queries put together from operators, and their DuckDB statements."""
