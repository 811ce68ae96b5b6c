"""weft: a PySpark-native engine for querying and maintaining a corpus of linked text pages."""
