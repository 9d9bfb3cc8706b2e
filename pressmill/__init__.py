"""pressmill: a PySpark-native engine for document-lifecycle analytics."""
