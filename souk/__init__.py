"""A Spark-first analytics engine for marketplace data."""
