"""Contest analytics on Spark: states, point-in-time features, predictions, audits."""
