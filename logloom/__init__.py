"""logloom: log analytics as Spark jobs."""
