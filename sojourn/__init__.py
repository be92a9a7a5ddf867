"""Clinical event-sequence analytics as Spark DataFrame jobs."""
