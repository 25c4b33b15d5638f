"""PySpark-native engine for semi-structured text studies."""
