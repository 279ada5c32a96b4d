"""Observation-quality analytics on Spark."""
