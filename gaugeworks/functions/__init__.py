"""Functions of the evaluation-analytics engine."""
