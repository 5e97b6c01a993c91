"""A PySpark-native text-analysis and text-matching engine."""
