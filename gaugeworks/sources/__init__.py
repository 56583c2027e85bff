"""Sources of the evaluation-analytics engine."""
