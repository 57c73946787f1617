"""trendspark: a PySpark-native trend-analytics engine."""
