"""Spark-native tracking analytics and corpus processing."""
