"""A PySpark-native engine for point-in-time analytics."""
