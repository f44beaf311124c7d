"""qirtas: a PySpark-native engine for text corpora and retrieval training data."""
