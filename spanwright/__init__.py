"""A PySpark-native analytics engine for document and slide reconstruction logic."""
