"""A Spark-native engine for software dependency health."""
