"""Tidewell: causal event analytics and text-corpus operators as Spark jobs."""
