"""Independent SQL for every registered query, written for DuckDB on the raw tables."""
