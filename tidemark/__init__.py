"""Spark-native operators for catalog, interaction and training-data analytics."""
