"""quern: a Spark-native engine for text chunks, embeddings and their evaluation."""

__version__ = "0.1.0"
