"""Extraction, flattening and evaluation of structured concepts from free-text records, on Spark."""
