"""tailwatch: a PySpark-native engine for event-driven tail-risk analysis."""
