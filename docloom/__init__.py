"""A PySpark-native engine that turns document collections into typed tables."""
