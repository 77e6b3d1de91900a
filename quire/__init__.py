"""Document-page classification and review analytics on Spark."""
