"""Document-knowledge analytics as Spark DataFrame operations."""
