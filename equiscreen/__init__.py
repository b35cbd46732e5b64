"""Spark-native equity screening and listing-universe analytics."""
