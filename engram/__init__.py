"""engram: a PySpark-native engine for source-pointer memory and session data."""
