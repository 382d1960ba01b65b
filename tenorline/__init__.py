"""Spark-native analytics: term structures of dated contracts, expressed as DataFrame transformations."""
