"""Interaction analytics on Spark: cleaning, rankings, splits, feedback, hybrid ranking and evaluation as DataFrame code."""
