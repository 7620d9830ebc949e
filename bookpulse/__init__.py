"""Client-book analytics as Spark DataFrame jobs."""
