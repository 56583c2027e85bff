"""Streaming of the evaluation-analytics engine."""
