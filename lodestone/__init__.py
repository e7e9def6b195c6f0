"""Spark-native static analysis of application packages and source trees."""
