"""PySpark-native analytics over writing-style corpora."""
