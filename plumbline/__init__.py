"""Data profiling and data quality as Spark jobs."""
