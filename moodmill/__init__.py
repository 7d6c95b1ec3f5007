"""Emotion text analytics as PySpark DataFrame jobs."""
