"""Query catalogue: registered Spark queries and their DuckDB oracle SQL."""
