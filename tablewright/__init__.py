"""A Spark-first engine for predictive analytics on wide tables."""
