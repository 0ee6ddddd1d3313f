"""Independent DuckDB SQL for every registered query (the correctness oracle)."""

from oracle.duckdb_sql import oracle_queries  # noqa: F401
