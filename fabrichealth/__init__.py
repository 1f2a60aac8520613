"""Fleet-wide fabric health analytics on Spark."""
