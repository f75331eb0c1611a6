"""Repository-context analytics expressed as Spark DataFrame jobs."""
