"""A PySpark-native engine for momentum analytics over append-only event streams."""
