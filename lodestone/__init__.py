"""Spark-native similarity search, candidate ranking and corpus preparation."""
