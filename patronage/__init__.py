"""Customer-data analytics on Spark: linkage, scrubbing, intake, metrics, reports and streams."""
