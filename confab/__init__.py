"""Chat-message analytics and training-data preparation as Spark jobs."""
