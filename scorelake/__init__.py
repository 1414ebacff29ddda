"""Evaluation analytics on Spark: score, aggregate, publish and rank model predictions."""
