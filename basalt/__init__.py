"""Spark-native analytics for preparing and auditing machine-learning datasets."""
