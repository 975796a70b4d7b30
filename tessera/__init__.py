"""Hybrid document retrieval and training-data preparation as Spark DataFrame jobs."""
