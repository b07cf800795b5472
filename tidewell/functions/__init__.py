"""Tidewell: causal event analytics on Spark."""
