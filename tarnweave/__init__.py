"""Tarnweave: a Spark-native engine for web corpora, hybrid retrieval and grounded answers."""
