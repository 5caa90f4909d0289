"""Process mining and corpus preparation on Spark."""
