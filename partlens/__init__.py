"""Part-status analytics written as Spark DataFrame jobs."""
