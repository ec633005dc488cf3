"""A Spark-native analytics engine for source quality."""
