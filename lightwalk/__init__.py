"""Street-level light exposure analytics on Spark."""
