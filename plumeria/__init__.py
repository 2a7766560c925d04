"""A PySpark-native analytics engine for large corpora of public submissions."""
