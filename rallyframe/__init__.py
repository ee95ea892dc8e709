"""Point-by-point match analytics as Spark DataFrame operations."""
