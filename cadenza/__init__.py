"""Catalogue analytics, popularity scoring and training-data operators on Spark."""
