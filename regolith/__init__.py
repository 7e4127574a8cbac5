"""Schema-registry analytics and training-data preparation on Spark."""
