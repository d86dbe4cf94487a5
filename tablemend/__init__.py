"""Probabilistic table cleaning as ordinary Spark jobs."""
