"""Dictionary-lookup analytics on Spark."""
