"""Spark-native semantic search and indexing for document vaults."""
