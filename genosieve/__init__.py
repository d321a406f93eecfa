"""A PySpark-native engine for surveillance-style analytics on dated, located samples."""
