"""Contest-forecast analytics as Spark DataFrame jobs."""
