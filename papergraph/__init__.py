"""Spark-native analytics over bibliographic records and other documents."""
