"""Spark-native corpus analytics: declarative DataFrame operators over document tables."""
