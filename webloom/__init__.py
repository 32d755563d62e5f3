"""Spark-native analytics over crawled web content."""
