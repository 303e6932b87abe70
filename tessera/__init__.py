"""Similarity search over polygons, and operators for training-data corpora, on Spark."""
