"""Media-performance analytics and corpus processing as Spark DataFrame jobs."""
