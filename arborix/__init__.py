"""Spatial-network and topology analytics as PySpark DataFrame jobs."""
