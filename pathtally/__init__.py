"""A PySpark-native engine for counting on sequence graphs."""
