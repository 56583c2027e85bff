"""Spark-native evaluation analytics: sources, functions, operators, plans and streams over DataFrames."""
