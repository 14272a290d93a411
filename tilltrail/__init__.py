"""tilltrail: retail transaction analytics as Spark DataFrame jobs."""
