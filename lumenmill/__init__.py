"""PySpark-native sample generation."""
