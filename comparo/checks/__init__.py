"""Independent SQL oracle (DuckDB dialect) for the query catalogue."""
