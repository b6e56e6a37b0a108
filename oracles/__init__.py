"""DuckDB statements that state the expected result of each query independently of Spark."""
