"""A PySpark-native analytics engine for measurement pipelines."""
