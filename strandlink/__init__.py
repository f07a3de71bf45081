"""Similarity joins and single-linkage clustering of short sequences on Spark."""
