"""Beat-interval analytics on Spark: sources, interval algebra, variability features, detection events and metrics."""
