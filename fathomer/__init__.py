"""A Spark-native engine for incremental document processing and hybrid retrieval."""

__version__ = "0.1.0"
