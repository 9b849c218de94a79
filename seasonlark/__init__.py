"""seasonlark: gridded and site time-series analytics as Spark DataFrame jobs."""
