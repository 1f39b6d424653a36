"""PySpark-native analytics over the internal structure of PDF corpora."""
