"""Spark-native analytics for agricultural production, weather and risk data."""
