"""A PySpark-native hybrid retrieval engine."""
