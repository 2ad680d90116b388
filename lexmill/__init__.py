"""lexmill: a PySpark-native engine for lexical and semantic search over sense tables."""
