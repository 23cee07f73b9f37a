"""PySpark-native analytics for document-to-solution pipelines."""
