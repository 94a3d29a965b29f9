"""Spark-native prompt labelling, threshold tuning, scoring and routing."""
