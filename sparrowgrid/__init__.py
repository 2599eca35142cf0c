"""Spark-native analytics over text, embeddings and evidence that changes through time."""
