"""presswork: a Spark-native engine for multi-source news and document corpora."""

__version__ = "0.1.0"
