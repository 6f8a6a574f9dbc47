"""A PySpark-native engine for data whose field names say what they mean."""
