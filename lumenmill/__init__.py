"""lumenmill: a Spark-native engine for message-content analytics."""

__version__ = "0.1.0"
