"""thicket: a PySpark-native engine for text and tree-structured corpora."""
